"""Similarity statistics, threshold curves and the thresholds they recommend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks

#: Fixed value: what keeps the curve's denominators above zero.
EPSILON = 1e-8


def class_stats(sims: DataFrame, by: str) -> DataFrame:
    """count, mean, median, min, max and population deviation of `sim` for each value of `by`."""
    r = lambda c: F.round(c, 6)
    return sims.groupBy(by).agg(F.count("*").alias("n"), r(F.avg("sim")).alias("mean"), r(F.median("sim")).alias("median"), r(F.min("sim")).alias("min"), r(F.max("sim")).alias("max"), r(F.stddev_pop("sim")).alias("std"))


def pair_stats(vectors: DataFrame) -> DataFrame:
    """class_stats of the cosines of all unordered pairs, by `same` (of one group, or of two), without a row for any pair."""
    spark = vectors.sparkSession
    sums = {r["same"]: r for r in blocks.class_sums(vectors).collect()}  # two rows at most
    middle = {k: sorted({(r["n"] - 1) // 2, r["n"] // 2}) for k, r in sums.items()}
    medians = {k: sum(x) / len(x) for k, x in blocks.class_places(vectors, middle).items()}
    rows = []
    for k, r in sums.items():
        mean = r["total"] / r["n"]
        rows.append((k, r["n"], mean, medians[k], r["min"], r["max"], max(r["squares"] / r["n"] - mean * mean, 0.0) ** 0.5))
    got = spark.createDataFrame(rows, "same boolean, n long, mean double, median double, min double, max double, std double")
    return got.select("same", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "min", "max", "std")))


def curve(counts: DataFrame, low: float, step: float, bins: int) -> DataFrame:
    """(i, threshold, tp, fp, precision, recall, f1) from counts (same, bin, n) of similarities.

    A similarity in bin b reaches the thresholds 0..b; running sums from the
    top give every point in one pass over the bins.
    """
    spark = counts.sparkSession
    spine = spark.range(bins).select(F.col("id").cast("int").alias("i"))
    wide = counts.groupBy(F.col("bin").alias("i")).agg(F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(~F.col("same"), F.col("n")).otherwise(0)).alias("q"))
    total = wide.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("positives"))
    down = W.orderBy(F.col("i").desc()).rowsBetween(W.unboundedPreceding, 0)  # over the bins, a fixed number
    points = spine.join(wide, "i", "left").na.fill(0).select("i", F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp")).crossJoin(F.broadcast(total))
    p = F.col("tp") / (F.col("tp") + F.col("fp") + EPSILON)
    r = F.col("tp") / (F.col("positives") + EPSILON)
    points = points.select("i", (F.lit(low) + F.lit(step) * F.col("i")).alias("threshold"), "tp", "fp", p.alias("precision"), r.alias("recall"))
    return points.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + EPSILON))


def best(points: DataFrame, precision: float = 0.95) -> DataFrame:
    """The threshold of the greatest F1 (the lowest of equals), and the lowest that reaches a precision."""
    return points.agg(
        F.round(F.max_by("threshold", F.struct(F.round("f1", 10), -F.col("i"))), 6).alias("best_threshold"),
        F.round(F.max("f1"), 6).alias("best_f1"),
        F.round(F.min(F.when(F.col("precision") >= precision, F.col("threshold"))), 6).alias("precise_threshold"),
    )
