"""Statistics on results: bootstrap, signed ranks, agreement of clusterings, medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upper_median(x: Column) -> Column:
    """The value at position n div 2 of the sorted values, as an aggregate."""
    return F.element_at(F.array_sort(F.collect_list(x)), (F.count(x) / 2).cast("int") + 1)


def with_before(rows: DataFrame, key: str, amount: Column, ranges: int = 64, per_range: int = 16) -> DataFrame:
    """rows with `_before`: the sum of `amount` over the rows that precede in order of key, which tells rows apart; nulls come first.

    Windows run within ranges of the key, and the sums of the ranges before
    are added. Bounds come from a sample by hash; any bounds give the same
    sums. The driver sees ranges * per_range keys and a sum for each range.
    """
    sample = rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(ranges * per_range)
    bounds = [F.lit(r[0]) for r in sample.distinct().orderBy(key).collect()][per_range::per_range]
    place = F.size(F.filter(F.array(*bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    placed = rows.withColumn("_range", place)
    sums = {r["_range"]: r["s"] for r in placed.groupBy("_range").agg(F.sum(amount).alias("s")).collect()}
    starts = [sum(s for k, s in sums.items() if k < i) for i in range(len(bounds) + 1)]
    within = W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    start = F.get(F.array(*map(F.lit, starts)), F.col("_range"))
    return placed.withColumn("_before", start + F.coalesce(F.sum(amount).over(within), F.lit(0))).drop("_range")


def upper_median_of(rows: DataFrame, value: str) -> DataFrame:
    """(min, max, upper_median, n) of a column; counts by value, so memory follows distinct values only."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("k"))
    placed = with_before(counts, value, F.col("k")).select(value, (F.col("_before") + F.col("k")).alias("upto"))
    total = counts.agg(F.sum("k").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"))
    return placed.crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("n", "min", "max").agg(F.min(value).alias("upper_median")).select("min", "max", "upper_median", "n")


def bootstrap(rows: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(mean, low, high): percentile interval of the mean by Poisson resampling.

    A row's weight in a resample is drawn by its hash, so any partitioning
    gives the same interval, and partial sums are all that is shuffled.
    """
    u = (F.pmod(F.xxhash64(key, "b", F.lit(seed)), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = sum((F.when(u > s, 1).otherwise(0) for s in steps), F.lit(0))  # cumulative Poisson(1) probabilities
    weight = F.when(F.col("b") == 0, 1).otherwise(weight)  # resample 0 is the sample itself, so that rows are worked out once
    many = rows.where(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(0), F.lit(resamples))).alias("b")).withColumn("w", weight)
    means = many.groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    a = (1 - level) / 2
    drawn = F.when(F.col("b") > 0, F.col("m"))
    return means.agg(F.max(F.when(F.col("b") == 0, F.col("m"))).alias("mean"), F.percentile(drawn, F.lit(a)).alias("low"), F.percentile(drawn, F.lit(1 - a)).alias("high"))


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, ari) of two labelings, from the contingency table; 1 where both put all together or all apart."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    table = rows.groupBy(a, b).agg(F.count("*").alias("k"))
    cells = table.agg(F.sum(pairs("k")).alias("cells"), F.sum("k").alias("n"))
    side = lambda c, name: table.groupBy(c).agg(F.sum("k").alias("k")).agg(F.sum(pairs("k")).alias(name))
    one = cells.crossJoin(side(a, "rows")).crossJoin(side(b, "cols"))
    expected = F.col("rows") * F.col("cols") / pairs("n")
    most = (F.col("rows") + F.col("cols")) / 2
    return one.select("n", F.when(most == expected, 1.0).otherwise((F.col("cells") - expected) / (most - expected)).alias("ari"))


def wilcoxon(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank test of a - b: (n, w_plus, w_minus, z); zeros dropped, ties share their mean rank.

    Ranks come from counts of equal differences and of those before, summed
    by ranges of the difference.
    """
    d = rows.select(F.round(F.col(a) - F.col(b), 12).alias("d")).where("d <> 0")
    size = d.groupBy(F.abs("d").alias("x")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = with_before(size, "x", F.col("k")).select("k", "up", (F.col("_before") + (F.col("k") + 1) / 2).alias("rank"))
    s = ranked.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("rank") * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("rank") * (F.col("k") - F.col("up"))), F.lit(0.0)).alias("w_minus"), F.coalesce(F.sum(F.pow("k", F.lit(3)) - F.col("k")), F.lit(0.0)).alias("ties"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    z = F.coalesce(F.try_divide(F.col("w_plus") - n * (n + 1) / 4, spread), F.lit(0.0))
    return s.select("n", "w_plus", "w_minus", F.round(z, 6).alias("z"))


def hash_sample(rows: DataFrame, key: str, n: int, by: str | None = None, seed: str = "42") -> DataFrame:
    """n rows (of each `by`), chosen by the md5 of seed and key: the same on any engine and partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    if by is None:
        return rows.orderBy(h, key).limit(n)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(h, key))).where(F.col("_n") <= n).drop("_n")


def every_nth(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows spread evenly over the order of key: positions floor(i * count / n)."""
    total = rows.count()
    step = max(1, total // max(1, n))
    n_before = F.col("_before")
    return with_before(rows, key, F.lit(1)).where((n_before % step == 0) & (n_before < step * n)).drop("_before")
