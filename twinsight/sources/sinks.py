"""Sinks: JSON reports, partitioned tensors, edge lists, upserts, resumable work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines; one_file is for final reports of a few rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_tensors(views: DataFrame, path: str) -> None:
    """Per-view embeddings by encoder and mode; a rerun replaces only the partitions it holds."""
    views.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("encoder", "mode").parquet(path)


def write_edges(edges: DataFrame, path: str, metric: str) -> None:
    """(id_a, id_b, dist) of one metric; a pair that is absent was not computed."""
    edges.withColumn("metric", F.lit(metric)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows: by key new wins, other old rows stay."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that isn't done yet."""
    return work.join(done.select(keys).distinct(), keys, "left_anti")


def run_in_batches(spark: SparkSession, work: DataFrame, done_path: str, keys: list[str], step, batches: int = 8) -> int:
    """step(batch) for each hash batch of what isn't in done_path; its rows are appended there. Returns the batches run."""
    from .manifests import first_existing

    todo = work
    if first_existing(spark, [done_path]):
        todo = remaining(work, spark.read.parquet(done_path), keys)
    n = 0
    for k in range(batches):
        part = todo.where(F.pmod(F.xxhash64(*keys), F.lit(batches)) == k)
        if not part.isEmpty():
            step(part).write.mode("append").parquet(done_path)
            n += 1
    return n


def console_table(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(line): columns at fixed widths."""
    return df.select(F.format_string("  ".join(f"%-{w}s" for w in widths.values()), *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in widths)).alias("line"))


def write_both(detailed: DataFrame, path: str, by: list[str], metrics: list[str]) -> DataFrame:
    """Writes rows as Parquet under path/detailed and their means by `by` as JSON under path/summary; returns the summary read back."""
    detailed.write.mode("overwrite").parquet(f"{path}/detailed")
    spark = detailed.sparkSession
    kept = spark.read.schema(detailed.schema).parquet(f"{path}/detailed")
    summary = kept.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in metrics))
    summary.write.mode("overwrite").json(f"{path}/summary")
    return spark.read.schema(summary.schema).json(f"{path}/summary")
