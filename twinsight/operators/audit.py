"""Train and test contamination by near-duplicates, and what it does to nearest-neighbour accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import safe_div


def cross_split(pairs: DataFrame) -> Column:
    return F.col("split_a") != F.col("split_b")


def with_meta(pairs: DataFrame, meta: DataFrame) -> DataFrame:
    """pairs (a, b, sim) with category and split of both ends."""
    side = lambda s: meta.select(F.col("model_id").alias(s), F.col("category").alias(f"category_{s}"), F.col("split").alias(f"split_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def by_threshold(pairs: DataFrame, thresholds: list[float], floor: float) -> DataFrame:
    """(threshold, pairs, cross_pairs, test_models) of pairs with meta; thresholds below what was mined are refused."""
    if min(thresholds) < floor:
        raise ValueError("a threshold lies below the similarity down to which pairs were mined")
    grid = pairs.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    test = F.when(F.col("split_a") == "test", F.col("a")).otherwise(F.col("b"))
    over = pairs.crossJoin(F.broadcast(grid)).where("sim >= threshold").withColumn("test_id", F.when(F.col("split_a") != F.col("split_b"), test))
    return over.groupBy("threshold").agg(F.count("*").alias("pairs"), F.count_if(F.col("split_a") != F.col("split_b")).alias("cross_pairs"), F.countDistinct("test_id").alias("test_models"))


def pair_types(pairs: DataFrame) -> DataFrame:
    """(kind, n, percent) of pairs with meta."""
    kind = F.when(F.col("category_a") != F.col("category_b"), "cross_category").when(F.col("split_a") != F.col("split_b"), "cross_split_same_category").otherwise("same_split_same_category")
    counts = pairs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("kind", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def judged(nearest: DataFrame, meta: DataFrame) -> DataFrame:
    """(q, category, correct) of each test model's nearest train model (q, c)."""
    m = meta.select("model_id", "category")
    return nearest.join(m.toDF("q", "category"), "q").join(m.toDF("c", "found"), "c").select("q", "category", (F.col("category") == F.col("found")).alias("correct"))


def impact(results: DataFrame, duplicates: DataFrame, by: str | None = None) -> DataFrame:
    """Accuracy of all, of clean and of duplicated test models; results (q, category, correct), duplicates (q)."""
    marked = results.join(duplicates.select("q").distinct().withColumn("dup", F.lit(True)), "q", "left").withColumn("dup", F.coalesce("dup", F.lit(False)))
    ok = F.col("correct").cast("double")
    grouped = marked.groupBy(by) if by else marked.groupBy()
    out = grouped.agg(F.count("*").alias("n"), F.count_if("dup").alias("n_dup"), F.avg(ok).alias("full"), F.avg(F.when(~F.col("dup"), ok)).alias("clean"), F.avg(F.when(F.col("dup"), ok)).alias("only"))
    gap = F.col("full") - F.col("clean")
    r = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return out.select(*([by] if by else []), "n", "n_dup", r(F.col("full"), "full_accuracy"), r(F.col("clean"), "clean_accuracy"), r(F.col("only"), "dup_accuracy"), r(gap, "inflation"), r(100 * safe_div(gap, F.col("full")), "inflation_percent"))
