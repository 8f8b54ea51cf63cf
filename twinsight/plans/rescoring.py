"""Staged verification of candidates, its evaluation and its sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.verdicts import angle_prompt, is_evidence, screen_verdict, view_verdict
from ..operators import blocks, reporting, rescore
from .fixtures import N_VIEWS, STAGED, judged, models, sources, vectors
from .registry import query

MIN_EVIDENCE = 4


def _run(spark: SparkSession, d: str, skip: bool = False, k: int = 20):
    m = models(spark, d)
    near = blocks.nearest(vectors(sources(m)), vectors(m), k).select("q", "c", "sim")
    replies, evidence = judged(m, near)
    screen = rescore.screened(replies, skip)
    return m, screen, evidence, rescore.verified(screen, evidence, N_VIEWS, MIN_EVIDENCE)


def _asked(m: DataFrame) -> DataFrame:
    return sources(m).select(F.col("model_id").alias("q"))


@query(f"with {STAGED} select q, c, round(sim, 6) as sim, stage2, evidence_count, outcome from res")
def rescorer_results(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, res = _run(spark, d)
    return res.select("q", "c", F.round("sim", 6).alias("sim"), "stage2", "evidence_count", "outcome")


@query(f"with {STAGED} select q, c, n8 as evidence_count, case when n8 >= 4 then 'confirmed' else 'stage3' end as outcome from cnt")
def rescorer_skip_screen(spark: SparkSession, d: str) -> DataFrame:
    _, _, _, res = _run(spark, d, skip=True)
    return res.select("q", "c", "evidence_count", "outcome")


@query(f"""with {STAGED} select count(*) as candidates, count(*) filter (stage2 <> 'DIFFERENT') as stage2_passed, count(*) filter (stage2 = 'DIFFERENT') as stage2_rejected,
count(*) filter (stage2 = 'LIKELY_DUPLICATE') as stage2_likely, count(*) filter (stage2 = 'UNCERTAIN') as stage2_uncertain, count(*) filter (stage2 <> 'DIFFERENT') as stage3_entered,
count(*) filter (outcome = 'confirmed') as confirmed, count(*) filter (outcome = 'stage3') as stage3_rejected, count(*) + 8 * count(*) filter (stage2 <> 'DIFFERENT') as calls from res""")
def rescorer_funnel(spark: SparkSession, d: str) -> DataFrame:
    return rescore.funnel(_run(spark, d)[3], N_VIEWS)


@query(f"with {STAGED} select q, c, round(sim, 6) as sim, evidence_count from res where outcome = 'confirmed'")
def rescorer_confirmed(spark: SparkSession, d: str) -> DataFrame:
    res = _run(spark, d)[3].where("outcome = 'confirmed'")
    return res.select("q", "c", F.round("sim", 6).alias("sim"), "evidence_count")


_PRF = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(relevant, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(tp + fp + relevant, 0), 0), 6) as f1"


@query(f"""with {STAGED}, x as (select count(*) filter (rel.q is not null) as tp, count(*) filter (rel.q is null) as fp, (select count(*) from rel) as relevant
from res left join rel using (q, c) where outcome = 'confirmed') select tp, fp, relevant, {_PRF} from x""")
def rescorer_eval(spark: SparkSession, d: str) -> DataFrame:
    m, _, _, res = _run(spark, d)
    return rescore.evaluate(res.where("outcome = 'confirmed'"), m, _asked(m))


@query(f"""with {STAGED}, x as (select t.tier, (select count(*) from res join rel using (q, c) join m on m.model_id = c where outcome = 'confirmed' and m.tier = t.tier) as tp,
(select count(*) from res join m on m.model_id = c where outcome = 'confirmed' and m.tier = t.tier) as flagged, (select count(*) from rel join m on m.model_id = c where m.tier = t.tier) as relevant
from (values ('T1'), ('T2'), ('T3'), ('T4'), ('T5')) t(tier)), y as (select tier, tp, flagged - tp as fp, relevant from x) select tier, tp, fp, relevant, {_PRF} from y""")
def rescorer_by_tier(spark: SparkSession, d: str) -> DataFrame:
    m, _, _, res = _run(spark, d)
    return rescore.evaluate_by_tier(res.where("outcome = 'confirmed'"), m, _asked(m))


def _sweep_sql(views: list[int], limits: str) -> str:
    counts = " union all ".join(f"select q, c, {n} as n_views, n{n} as n from cnt" for n in views)
    return f"""with {STAGED}, w as ({counts}), x as (
  select n_views, t as min_evidence, count(*) filter (n >= t and rel.q is not null) as tp, count(*) filter (n >= t and rel.q is null) as fp, (select count(*) from rel) as relevant
  from w join scr using (q, c) left join rel using (q, c) cross join {limits} l(t) where stage2 <> 'DIFFERENT' group by n_views, t)
select n_views::int as n_views, min_evidence::int as min_evidence, tp, fp, relevant, {_PRF} from x"""


@query(_sweep_sql([8], "range(1, 9)"))
def evidence_sweep(spark: SparkSession, d: str) -> DataFrame:
    m, screen, evidence, _ = _run(spark, d)
    return rescore.sweep(evidence, screen, m, _asked(m), list(range(1, 9)), [N_VIEWS])


@query(_sweep_sql([2, 4, 6, 8], "(values (2))"))
def view_sweep(spark: SparkSession, d: str) -> DataFrame:
    m, screen, evidence, _ = _run(spark, d)
    return rescore.sweep(evidence, screen, m, _asked(m), [2], [2, 4, 6, 8])


@query(f"select 'ev' || min_evidence || '_v' || n_views as run_tag, tp, fp, relevant, precision, recall, f1 from ({_sweep_sql([4, 8], '(values (2), (4), (6))')})")
def ablation_summary(spark: SparkSession, d: str) -> DataFrame:
    """A row for each configuration of stored evidence: one job where a process for each configuration ran before."""
    m, screen, evidence, _ = _run(spark, d)
    rows = rescore.sweep(evidence, screen, m, _asked(m), [2, 4, 6], [4, 8])
    return rows.select(F.format_string("ev%d_v%d", "min_evidence", "n_views").alias("run_tag"), "tp", "fp", "relevant", "precision", "recall", "f1")


@query(f"""with {STAGED} select count(*) as rejected, count(*) filter (rel.q is null) as true_negatives, count(*) filter (rel.q is not null) as false_negatives, 8 * count(*) as saved_calls
from res left join rel using (q, c) where stage2 = 'DIFFERENT'""")
def stage2_quality(spark: SparkSession, d: str) -> DataFrame:
    m, screen, _, _ = _run(spark, d)
    return rescore.screen_quality(screen, m, N_VIEWS)


@query(f"""with {STAGED}, steps as (select 1 as stage, 'retrieved' as name, count(*) as n from res union all select 2, 'screened', count(*) filter (stage2 <> 'DIFFERENT') from res union all select 3, 'confirmed', count(*) filter (outcome = 'confirmed') from res)
select stage, name, n, round(coalesce(100.0 * n / lag(n) over (order by stage), 100.0), 6) as percent from steps""")
def funnel_rates(spark: SparkSession, d: str) -> DataFrame:
    f = rescore.funnel(_run(spark, d)[3], N_VIEWS)
    long = f.select(F.explode(F.array(*(F.struct(F.lit(i).alias("stage"), F.lit(n).alias("name"), F.col(c).alias("n")) for i, n, c in ((1, "retrieved", "candidates"), (2, "screened", "stage3_entered"), (3, "confirmed", "confirmed"))))).alias("x"))
    return reporting.pass_rates(long.select("x.*"))


@query(f"with {STAGED} select q, c, outcome from (select *, row_number() over (partition by outcome order by q, c) as k from res where outcome <> 'stage2') where k <= 3")
def example_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.examples(_run(spark, d)[3]).select("q", "c", "outcome")


@query(f"with {STAGED} select q as query, count(*) filter (outcome = 'confirmed') as n_confirmed, count(*) filter (outcome <> 'confirmed') as n_rejected, count(*) filter (outcome <> 'stage2') * 8 as n_angles from res group by q")
def rescorer_nested(spark: SparkSession, d: str) -> DataFrame:
    _, _, evidence, res = _run(spark, d)
    n = rescore.nested(res, evidence)
    angles = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + F.coalesce(F.nullif(F.size(x["angle_details"]), F.lit(-1)), F.lit(0)))
    return n.select("query", F.size("confirmed_duplicates").cast("long").alias("n_confirmed"), F.size("rejected").cast("long").alias("n_rejected"), (angles("confirmed_duplicates") + angles("rejected")).cast("long").alias("n_angles"))


_REPLIES = "(1, 'LIKELY_DUPLICATE'), (2, 'i think likely_duplicate, not different'), (3, 'Different'), (4, 'no idea'), (5, null), (6, 'EVIDENCE found'), (7, 'NO_EVIDENCE'), (8, 'no_evidence, though some evidence'), (9, '')"


@query(f"""select id, case when contains(upper(reply), 'LIKELY_DUPLICATE') then 'LIKELY_DUPLICATE' when contains(upper(reply), 'DIFFERENT') then 'DIFFERENT' else 'UNCERTAIN' end as screen,
coalesce(contains(upper(reply), 'EVIDENCE') and not contains(upper(reply), 'NO_EVIDENCE'), false) as evidence,
case when reply is null then 'ERROR' when contains(upper(reply), 'EVIDENCE') and not contains(upper(reply), 'NO_EVIDENCE') then 'EVIDENCE' else 'NO_EVIDENCE' end as verdict,
'Compare at ' || (45 * id) || ' degrees' as prompt from (values {_REPLIES}) t(id, reply)""")
def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(f"select * from values {_REPLIES} as t(id, reply)")
    r = F.col("reply")
    return rows.select("id", screen_verdict(r).alias("screen"), is_evidence(r).alias("evidence"), view_verdict(r).alias("verdict"), angle_prompt("Compare at %d degrees", 45 * F.col("id")).alias("prompt"))


@query(f"""with {STAGED}, e as (select q, c, view_idx, case when x >= 0.3 then 1 else 0 end as yes from ev)
select view_idx::int as view_idx, count(*) as calls, sum(yes)::bigint as with_evidence, round(avg(yes), 6) as share from e group by view_idx""")
def call_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Calls and evidence for each view, from the stored call log."""
    evidence = _run(spark, d)[2].withColumn("yes", is_evidence(F.col("reply")).cast("int"))
    return evidence.groupBy("view_idx").agg(F.count("*").alias("calls"), F.sum("yes").alias("with_evidence"), F.round(F.avg("yes"), 6).alias("share"))
