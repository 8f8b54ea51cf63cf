"""The supplied tables as models, views, point clouds and a deterministic judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles

N_VIEWS, VIEW_DIM = 8, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, source_uid, is_source, tier, split, e): the smallest id of a label is its source."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("first_id"))
    rows = e.join(first, "label").select(F.col("vec_id").alias("model_id"), F.col("label").cast("long").alias("source_uid"), (F.col("vec_id") == F.col("first_id")).alias("is_source"), doubles("embedding").alias("e"))
    tier = F.when(~F.col("is_source"), F.concat(F.lit("T"), (1 + F.col("model_id") % 5).cast("string")))
    return rows.select("model_id", "source_uid", "is_source", tier.alias("tier"), F.when(F.expr("(model_id div 5) % 5 = 0"), "test").otherwise("train").alias("split"), "e")


def vectors(m: DataFrame) -> DataFrame:
    """(id, grp, vector) for blocked products."""
    return m.select(F.col("model_id").alias("id"), F.col("source_uid").alias("grp"), F.col("e").alias("vector"))


def views(m: DataFrame) -> DataFrame:
    """(model_id, view_idx, emb): eight slices of each vector."""
    return m.select("model_id", "e", F.explode(F.sequence(F.lit(0), F.lit(N_VIEWS - 1))).alias("view_idx")).select("model_id", "view_idx", F.slice("e", F.col("view_idx") * VIEW_DIM + 1, VIEW_DIM).alias("emb"))


def view_of(e: str, v) -> F.Column:
    return F.slice(e, v * VIEW_DIM + 1, VIEW_DIM)


def points(m: DataFrame) -> DataFrame:
    """(model_id, pt_idx, x, y, z): the first three components of each view."""
    return views(m).select("model_id", F.col("view_idx").alias("pt_idx"), *(F.col("emb")[k].alias(i) for k, i in enumerate("xyz")))


def sources(m: DataFrame) -> DataFrame:
    return m.where("is_source")


def judged(m: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies of a deterministic judge to candidates (q, c, sim): screening by view 0, evidence by every view."""
    side = lambda s: m.select(F.col("model_id").alias(s), F.col("e").alias(f"e{s}"))
    both = candidates.join(side("q"), "q").join(side("c"), "c")
    x = cosine(view_of("eq", F.lit(0)), view_of("ec", F.lit(0)))
    reply = F.when(x < 0, "They look DIFFERENT to me.").when(x >= 0.3, "likely_duplicate").otherwise("Hard to say.")
    screen = both.select("q", "c", "sim", reply.alias("reply"), F.lit(True).alias("has_views"))
    flat = both.select("q", "c", "eq", "ec", F.explode(F.sequence(F.lit(0), F.lit(N_VIEWS - 1))).alias("view_idx"))
    y = cosine(view_of("eq", F.col("view_idx")), view_of("ec", F.col("view_idx")))
    evidence = flat.select("q", "c", "view_idx", F.when(y >= 0.3, "EVIDENCE of the same origin").otherwise("NO_EVIDENCE").alias("reply"))
    return screen, evidence


#: The same in SQL, to begin an oracle with.
M = """
m as (
  select vec_id as model_id, label::bigint as source_uid, vec_id = min(vec_id) over (partition by label) as is_source,
    embedding::double[] as e, case when (vec_id // 5) % 5 = 0 then 'test' else 'train' end as split,
    case when vec_id <> min(vec_id) over (partition by label) then 'T' || (1 + vec_id % 5)::varchar end as tier
  from embeddings
)"""

PAIRS = M + """,
s as (
  select a.model_id as q, b.model_id as c, a.source_uid as gq, b.source_uid as gc, list_cosine_similarity(a.e, b.e) as sim
  from m a join m b on a.model_id <> b.model_id
)"""

RANKED = PAIRS + """,
r as (select *, row_number() over (partition by q order by round(sim, 12) desc, c) as rnk from s),
h as (select *, row_number() over (partition by q order by rnk) as hit from r where gq = gc),
ap as (
  select q, count(*) as n_relevant, sum(hit / rnk) / count(*) as ap,
    count(*) filter (rnk <= 1) / 1.0 as p1, count(*) filter (rnk <= 5) / 5.0 as p5, count(*) filter (rnk <= 10) / 10.0 as p10,
    count(*) filter (rnk <= 10) / count(*) as r10, count(*) filter (rnk <= 50) / count(*) as r50
  from h group by q
)"""

STAGED = PAIRS + """,
cand as (
  select * from (select s.*, row_number() over (partition by q order by round(sim, 12) desc, c) as rank from s join m on m.model_id = s.q where m.is_source) where rank <= 20
),
ev as (
  select cand.q, cand.c, v.v as view_idx, list_cosine_similarity(a.e[8*v.v+1:8*v.v+8], b.e[8*v.v+1:8*v.v+8]) as x
  from cand join m a on a.model_id = cand.q join m b on b.model_id = cand.c cross join range(8) v(v)
),
scr as (
  select cand.q, cand.c, cand.sim, case when x < 0 then 'DIFFERENT' when x >= 0.3 then 'LIKELY_DUPLICATE' else 'UNCERTAIN' end as stage2
  from cand join ev on ev.q = cand.q and ev.c = cand.c and ev.view_idx = 0
),
cnt as (select q, c, count(*) filter (x >= 0.3) as n8, count(*) filter (x >= 0.3 and view_idx < 2) as n2, count(*) filter (x >= 0.3 and view_idx < 4) as n4, count(*) filter (x >= 0.3 and view_idx < 6) as n6 from ev group by q, c),
res as (
  select scr.*, case when stage2 <> 'DIFFERENT' then n8 end as evidence_count,
    case when stage2 = 'DIFFERENT' then 'stage2' when n8 >= 4 then 'confirmed' else 'stage3' end as outcome
  from scr join cnt using (q, c)
),
rel as (select a.model_id as q, b.model_id as c from m a join m b on a.source_uid = b.source_uid and a.model_id <> b.model_id where a.is_source)"""
