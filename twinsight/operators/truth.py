"""Ground truth: which source each model belongs to, and what is relevant to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ground_truth(sources: DataFrame, clones: DataFrame) -> DataFrame:
    """(model_id, source_uid, tier, is_source): sources have no tier."""
    own = sources.select(F.col("uid").alias("model_id"), F.col("uid").alias("source_uid"), F.lit(None).cast("string").alias("tier"), F.lit(True).alias("is_source"))
    return own.unionByName(clones.select(F.col("clone_id").alias("model_id"), "source_uid", "tier", F.lit(False).alias("is_source")))


def resolve_sources(models: DataFrame, truth: DataFrame) -> DataFrame:
    """models with source_uid, tier and is_source; an unknown id is its own group."""
    joined = models.join(truth, "model_id", "left")
    return joined.withColumns({"source_uid": F.coalesce("source_uid", "model_id"), "is_source": F.coalesce("is_source", F.lit(False))})


def relevance_pairs(truth: DataFrame) -> DataFrame:
    """(q, c): same source, not itself."""
    q = truth.select(F.col("model_id").alias("q"), "source_uid")
    c = truth.select(F.col("model_id").alias("c"), "source_uid")
    return q.join(c, "source_uid").where("q <> c").select("source_uid", "q", "c")


def group_sizes(truth: DataFrame) -> DataFrame:
    """(model_id, source_uid, n_relevant) without making the pairs."""
    sizes = truth.groupBy("source_uid").agg((F.count("*") - 1).alias("n_relevant"))
    return truth.join(sizes, "source_uid").select("model_id", "source_uid", "n_relevant")


def negative_sample(truth: DataFrame, per_model: int, known: DataFrame | None = None, seed: str = "42", bucket_rows: int = 64) -> DataFrame:
    """(a, b): up to per_model models of other sources for each model, as canonical distinct pairs.

    Models are dealt into hash buckets of about bucket_rows, and partners are
    drawn from a model's own bucket in hash order: candidates grow in
    proportion to the models. Pairs in `known` (a, b) are left out.
    """
    buckets = max(1, truth.count() // max(bucket_rows, 3 * per_model))
    bucket = F.pmod(F.xxhash64("model_id", F.lit(seed)), F.lit(buckets)).alias("bucket")
    own = truth.select(F.col("model_id").alias("x"), F.col("source_uid").alias("sx"), bucket)
    other = truth.select(F.col("model_id").alias("y"), F.col("source_uid").alias("sy"), bucket)
    met = own.join(other, "bucket").where("sx <> sy")
    order = W.partitionBy("x").orderBy(F.xxhash64(F.lit(seed), F.least("x", "y"), F.greatest("x", "y")), "y")
    drawn = met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_model)
    pairs = drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs if known is None else pairs.join(known, ["a", "b"], "left_anti")
