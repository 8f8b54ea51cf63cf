"""Tables behind the figures; drawing is left to the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIERS = ("T1", "T2", "T3", "T4", "T5")


def best_by(results: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """The row of each group with the greatest value; of equals the first key."""
    order = W.partitionBy(group).orderBy(F.col(value).desc(), key)
    return results.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def tier_heatmap(long: DataFrame, row: str, value: str) -> DataFrame:
    """A column for each tier, rows in order of their total; missing tiers are 0."""
    wide = long.groupBy(row).pivot("tier", list(TIERS)).agg(F.first(value)).na.fill(0.0)
    return wide.withColumn("total", sum((F.col(t) for t in TIERS[1:]), F.col(TIERS[0]))).orderBy(F.col("total").desc(), row)


def crossed(long: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """row x column table of a value; what is missing is 0."""
    return long.groupBy(row).pivot(column, values).agg(F.first(value)).na.fill(0.0).orderBy(row)


def melted(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return wide.unpivot(keys, metrics, "metric", "value")


def ranked(results: DataFrame, value: str, key: str) -> DataFrame:
    return results.orderBy(F.col(value).desc(), key)


def gains(series: DataFrame, order: str, value: str) -> DataFrame:
    """value with its change from the row before, in order (a few rows)."""
    return series.withColumn("gain", F.round(F.col(value) - F.lag(value).over(W.orderBy(order)), 6))


def pass_rates(stages: DataFrame) -> DataFrame:
    """(stage, name, n, percent) of what the stage before let through (a few rows)."""
    before = F.lag("n").over(W.orderBy("stage"))
    return stages.withColumn("percent", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), before), F.lit(100.0)), 6))


def examples(results: DataFrame, n: int = 3) -> DataFrame:
    """The first n confirmed and the first n stage-3 rejections, by query and candidate."""
    some = results.where(F.col("outcome").isin("confirmed", "stage3"))
    return some.withColumn("_n", F.row_number().over(W.partitionBy("outcome").orderBy("q", "c"))).where(F.col("_n") <= n).drop("_n")


def tier_precision(metrics: DataFrame) -> DataFrame:
    """precision from either of two names, else 0."""
    have = [F.col(c) for c in ("embedding_precision", "precision") if c in metrics.columns]
    return metrics.withColumn("precision", F.coalesce(*have, F.lit(0.0)))


def in_order(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of the listed keys, in the list's order."""
    tags = table.sparkSession.createDataFrame(list(enumerate(order)), f"_i int, {key} string")
    return table.join(F.broadcast(tags), key).orderBy("_i").drop("_i")


def select_roles(models: DataFrame, roles: list[str] | None = None, tiers: list[str] | None = None) -> DataFrame:
    """Rows of models (is_source, tier) of the given roles ('source', 'clone'; none: both); clones of the given tiers (none: all)."""
    source = F.coalesce("is_source", F.lit(False))
    of_role = reduce(lambda a, b: a | b, ({"source": source, "clone": ~source}[r] for r in roles)) if roles else F.lit(True)
    return models.where(of_role & (source | F.col("tier").isin(tiers)) if tiers else of_role)


def configurations(results: DataFrame, key: str = "config", starts: str | None = None, contains: str | None = None, lacks: str | None = None) -> DataFrame:
    """Results whose configuration key starts with, contains and lacks the given texts; null keys go."""
    keep = F.col(key).isNotNull()
    for text, fits in ((starts, F.col(key).startswith(starts or "")), (contains, F.col(key).contains(contains or "")), (lacks, ~F.col(key).contains(lacks or ""))):
        keep = keep if text is None else keep & fits
    return results.where(keep)


def render_modes(results: DataFrame, metrics: list[str], mode: str = "mode", base: str = "plain") -> DataFrame:
    """(mode, n, and of each metric its mean and the mean's difference to the base mode's) of results, one row for each render mode."""
    means = results.groupBy(mode).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))
    own = means.where(F.col(mode) == base).select(*(F.col(m).alias(f"{m}_base") for m in metrics))
    return means.crossJoin(F.broadcast(own)).select(mode, "n", *metrics, *((F.col(m) - F.col(f"{m}_base")).alias(f"{m}_gain") for m in metrics))  # one row at most
