"""Structured Streaming over new embeddings and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators.blocks import keep, similar


def read_embeddings(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(stream: DataFrame, corpus: DataFrame, threshold: float, out: str, checkpoint: str):
    """Scores each micro-batch of (id, grp, vector) against a static corpus in tiles, and appends (q, c, sim).

    A batch is written under its own number and replaced if it runs again, so
    that each pair is there once. The corpus is cut into tiles once, beside the
    checkpoint, when the stream starts; a batch's plan is only its own product
    with them, so what the driver keeps for each batch is small.
    """
    kept = keep(corpus, f"{checkpoint.rstrip('/')}-corpus")

    def score(batch: DataFrame, number: int) -> None:
        if rows := batch.count():
            similar(batch, kept, threshold, sizes=(rows, kept.rows)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows of probes that travel to every task; more go through score_stream's tiles.
MAX_PROBES = 1024


def score_small(stream: DataFrame, probes: DataFrame, threshold: float) -> DataFrame:
    """Stream-static join with a few probes (q, qv); all of it in the JVM.

    Probes are broadcast, so their number is checked: beyond MAX_PROBES this
    refuses, and score_stream is the way, whose tiles know no such bound.
    """
    if probes.limit(MAX_PROBES + 1).count() > MAX_PROBES:
        raise ValueError(f"more than {MAX_PROBES} probes: use score_stream")
    return stream.join(F.broadcast(probes), cosine("vector", "qv") >= threshold).select("q", F.col("id").alias("c"), cosine("vector", "qv").alias("sim"))


def with_time(events: DataFrame) -> DataFrame:
    """events with `ts` as an instant; a time without zone counts as UTC (the session's zone)."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Uploads that repeat a key within the delay are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of tumbling or sliding windows; the same for batches and streams."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str = "10 minutes") -> DataFrame:
    """(user_id, start, stop, n) of each user's sessions."""
    agg = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return agg.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")
