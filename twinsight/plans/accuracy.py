"""Calibration of thresholds, and the audit of train and test contamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, blocks, calibrate, cluster
from .fixtures import M, PAIRS, models, vectors
from .registry import query

LOW, STEP, BINS = -0.3, 0.005, 140
TAUS = (0.20, 0.25, 0.30, 0.35, 0.40)


@query(f"with {PAIRS} select gq = gc as same, count(*) as n, round(avg(sim), 6) as mean, round(median(sim), 6) as median, round(min(sim), 6) as min, round(max(sim), 6) as max, round(stddev_pop(sim), 6) as std from s where q < c group by 1")
def sim_stats_by_class(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.pair_stats(vectors(models(spark, d)))


_CURVE = f"""with {PAIRS}, th as (select i::int as i, {LOW} + {STEP} * i as threshold from range({BINS}) r(i)),
x as (select i, threshold, count(*) filter (sim >= threshold and gq = gc) as tp, count(*) filter (sim >= threshold and gq <> gc) as fp, count(*) filter (gq = gc) as positives from s cross join th where q < c group by i, threshold),
p as (select *, tp / (tp + fp + 1e-8) as precision, tp / (positives + 1e-8) as recall from x),
f as (select *, 2 * precision * recall / (precision + recall + 1e-8) as f1 from p)"""


def _curve(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(models(spark, d))
    return calibrate.curve(blocks.histogram(v, LOW, STEP, BINS), LOW, STEP, BINS)


@query(f"{_CURVE} select i, tp, fp, round(threshold, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from f")
def calibration_curve(spark: SparkSession, d: str) -> DataFrame:
    c = _curve(spark, d)
    return c.select("i", "tp", "fp", *(F.round(k, 6).alias(k) for k in ("threshold", "precision", "recall", "f1")))


@query(f"{_CURVE} select round(arg_max(threshold, (round(f1, 10), -i)), 6) as best_threshold, round(max(f1), 6) as best_f1, round(min(threshold) filter (precision >= 0.12), 6) as precise_threshold from f")
def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.best(_curve(spark, d), 0.12)


def _pairs(m: DataFrame) -> DataFrame:
    """Pairs of all models down to the least threshold, with category (label) and split."""
    v = vectors(m)
    meta = m.select("model_id", F.col("source_uid").alias("category"), "split")
    return audit.with_meta(blocks.similar(v, v, TAUS[0], ordered=True).select(F.col("q").alias("a"), F.col("c").alias("b"), "sim"), meta)


_AUDIT = f"""with {PAIRS}, p as (select s.q as a, s.c as b, sim, gq as ca, gc as cb, ma.split as sa, mb.split as sb from s join m ma on ma.model_id = s.q join m mb on mb.model_id = s.c where s.q < s.c and sim >= 0.2)"""


@query(f"{_AUDIT} select a, b, round(sim, 6) as sim from p where ca = cb and sa <> sb and sim >= 0.25")
def audit_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(models(spark, d)).where("category_a = category_b and split_a <> split_b and sim >= 0.25")
    return p.select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"{_AUDIT} select a, b, round(sim, 6) as sim from p where ca = cb and sa <> sb order by round(sim, 12) desc, a, b limit 20")
def audit_top_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(models(spark, d)).where("category_a = category_b and split_a <> split_b")
    return p.orderBy(F.round("sim", 12).desc(), "a", "b").limit(20).select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"{_AUDIT} select t as threshold, count(*) as pairs, count(*) filter (sa <> sb) as cross_pairs, count(distinct case when sa <> sb then case when sa = 'test' then a else b end end) as test_models from p cross join (values (0.2::double), (0.25), (0.3), (0.35), (0.4)) v(t) where ca = cb and sim >= t group by t")
def audit_by_threshold(spark: SparkSession, d: str) -> DataFrame:
    return audit.by_threshold(_pairs(models(spark, d)).where("category_a = category_b"), list(TAUS), TAUS[0])


@query(f"{_AUDIT} select case when ca <> cb then 'cross_category' when sa <> sb then 'cross_split_same_category' else 'same_split_same_category' end as kind, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 6) as percent from p group by 1")
def pair_types(spark: SparkSession, d: str) -> DataFrame:
    return audit.pair_types(_pairs(models(spark, d)))


_NN = f"""{_AUDIT}, nn as (select s.q, s.gq as category, arg_max(s.gc, (round(sim, 12), -s.c)) = s.gq as correct from s join m mq on mq.model_id = s.q join m mc on mc.model_id = s.c where mq.split = 'test' and mc.split = 'train' group by s.q, s.gq),
dup as (select distinct case when sa = 'test' then a else b end as q from p where ca = cb and sa <> sb and sim >= 0.3),
z as (select nn.*, dup.q is not null as dup from nn left join dup using (q))"""
_IMPACT = "count(*) as n, count(*) filter (dup) as n_dup, round(avg(correct::int), 6) as full_accuracy, round(coalesce(avg(correct::int) filter (not dup), 0), 6) as clean_accuracy, round(coalesce(avg(correct::int) filter (dup), 0), 6) as dup_accuracy, round(coalesce(avg(correct::int) - avg(correct::int) filter (not dup), 0), 6) as inflation, round(coalesce(100 * (avg(correct::int) - avg(correct::int) filter (not dup)) / nullif(avg(correct::int), 0), 0), 6) as inflation_percent"


def _judged(m: DataFrame) -> DataFrame:
    meta = m.select("model_id", F.col("source_uid").alias("category"), "split")
    near = blocks.nearest(vectors(m.where("split = 'test'")), vectors(m.where("split = 'train'")), 1)
    return audit.judged(near, meta)


def _dups(m: DataFrame) -> DataFrame:
    p = _pairs(m).where("category_a = category_b and split_a <> split_b and sim >= 0.3")
    return p.select(F.when(F.col("split_a") == "test", F.col("a")).otherwise(F.col("b")).alias("q"))


@query(f"{_NN} select q, category, correct from nn")
def nn1_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _judged(models(spark, d))


@query(f"{_NN} select {_IMPACT} from z")
def audit_impact(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    return audit.impact(_judged(m), _dups(m))


@query(f"{_NN} select category, {_IMPACT} from z group by category")
def category_impact(spark: SparkSession, d: str) -> DataFrame:
    m = models(spark, d)
    return audit.impact(_judged(m), _dups(m), "category")


@query(f"with {M} select split, coalesce(tier, 'source') as tier, count(*) as n from m group by 1, 2")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return models(spark, d).groupBy("split", F.coalesce("tier", F.lit("source")).alias("tier")).agg(F.count("*").alias("n"))


@query()
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters and noise of each label's vectors."""
    found = cluster.cluster(vectors(models(spark, d)))
    return found.groupBy("grp").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.count_if(F.col("cluster") < 0).alias("n_noise"))
