"""Staged verification: retrieve, screen, verify; and its evaluation and sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import f1, safe_div
from ..functions.verdicts import DIFFERENT, LIKELY, SKIPPED, UNCERTAIN, angle_prompt, is_evidence, screen_verdict

TIERS = ("T1", "T2", "T3", "T4", "T5")


class Judge(Protocol):
    """Answers a prompt about two contents, or None when it can't."""

    def __call__(self, prompt: str, a: bytes | None, b: bytes | None) -> str | None: ...


def ask(pairs: DataFrame, judge: Callable[[], Judge], retries: int = 3, wait: float = 1.0) -> DataFrame:
    """pairs (prompt, a, b, ...) with `reply`; failed calls are retried after wait * 2^attempt seconds, then null.

    `judge` makes a client in each task. Write the result before using it
    twice: a task that runs again asks again.
    """
    import time

    from pyspark.sql.types import StringType, StructField, StructType

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = judge()
        for part in parts:
            replies = []
            for prompt, a, b in zip(part["prompt"], part["a"], part["b"], strict=True):
                reply = None
                for attempt in range(retries):
                    try:
                        reply = client(prompt, a, b)
                        break
                    except Exception:
                        if attempt + 1 < retries:
                            time.sleep(wait * 2**attempt)
                replies.append(reply)
            yield part.assign(reply=replies)

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField("reply", StringType())]))


def screened(candidates: DataFrame, skip: bool = False) -> DataFrame:
    """candidates (q, c, reply, has_views) with stage2 verdicts.

    A missing view or reply is uncertain, and counts neither as passed nor as
    rejected; with skip everything goes on, as skipped.
    """
    if skip:
        return candidates.withColumn("stage2", F.lit(SKIPPED)).withColumn("counted", F.lit(False))
    answered = F.col("has_views") & F.col("reply").isNotNull()
    verdict = F.when(answered, screen_verdict(F.col("reply"))).otherwise(F.lit(UNCERTAIN))
    return candidates.withColumn("stage2", verdict).withColumn("counted", F.coalesce(answered, F.lit(False)))


def verified(screen: DataFrame, evidence: DataFrame, n_views: int, min_evidence: int) -> DataFrame:
    """(q, c, sim, stage2, counted, evidence_count, outcome); evidence (q, c, view_idx, reply).

    What screening found different is rejected at stage 2 and asks no views.
    """
    asked = screen.where(F.col("stage2") != DIFFERENT).select("q", "c")
    count = evidence.where(F.col("view_idx") < n_views).join(asked, ["q", "c"], "left_semi").groupBy("q", "c").agg(F.count_if(is_evidence(F.col("reply"))).alias("evidence_count"))
    out = screen.join(count, ["q", "c"], "left")
    seen = F.when(F.col("stage2") != DIFFERENT, F.coalesce("evidence_count", F.lit(0)))
    outcome = F.when(F.col("stage2") == DIFFERENT, "stage2").when(F.coalesce(seen, F.lit(0)) >= min_evidence, "confirmed").otherwise("stage3")
    return out.withColumn("evidence_count", seen).withColumn("outcome", outcome)


def funnel(results: DataFrame, n_views: int) -> DataFrame:
    """Counters of a run, derived from its rows: a task that runs again counts once."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return results.agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("counted") & (F.col("stage2") != DIFFERENT)).alias("stage2_passed"),
        F.count_if(F.col("counted") & (F.col("stage2") == DIFFERENT)).alias("stage2_rejected"),
        is_("stage2", LIKELY).alias("stage2_likely"), is_("stage2", UNCERTAIN).alias("stage2_uncertain"),
        F.count_if(F.col("stage2") != DIFFERENT).alias("stage3_entered"),
        is_("outcome", "confirmed").alias("confirmed"), is_("outcome", "stage3").alias("stage3_rejected"),
        (F.count("*") + F.count_if(F.col("stage2") != DIFFERENT) * n_views).alias("calls"),
    )


def micro(tp: Column, fp: Column, relevant: Column) -> list[Column]:
    """precision, recall and f1 of counts; 0 where undefined."""
    p, r = safe_div(tp, tp + fp), safe_div(tp, relevant)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1")]


def evaluate(confirmed: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: tp, fp, relevant, precision, recall, f1. Relevant items come from the manifest, not from what was retrieved."""
    pairs = relevant_of(truth, queries)
    flagged = confirmed.select("q", "c").join(pairs.withColumn("is_rel", F.lit(True)), ["q", "c"], "left")
    counts = flagged.agg(F.count_if(F.col("is_rel")).alias("tp"), F.count_if(F.col("is_rel").isNull()).alias("fp"))
    return counts.crossJoin(pairs.agg(F.count("*").alias("relevant"))).select("tp", "fp", "relevant", *micro(F.col("tp"), F.col("fp"), F.col("relevant")))


def relevant_of(truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, c) relevant to the queries (q)."""
    q = queries.select("q").join(truth.select(F.col("model_id").alias("q"), "source_uid"), "q")
    return q.join(truth.select(F.col("model_id").alias("c"), "source_uid"), "source_uid").where("q <> c").select("q", "c")


def evaluate_by_tier(confirmed: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """A row for each tier of the *candidate*; candidates that are sources count in none."""
    tier = truth.where("tier is not null").select(F.col("model_id").alias("c"), "tier")
    pairs = relevant_of(truth, queries).join(tier, "c")
    flagged = confirmed.select("q", "c").join(tier, "c").join(pairs.select("q", "c", F.lit(True).alias("is_rel")), ["q", "c"], "left")
    hits = flagged.groupBy("tier").agg(F.count_if(F.col("is_rel")).alias("tp"), F.count_if(F.col("is_rel").isNull()).alias("fp"))
    want = pairs.groupBy("tier").agg(F.count("*").alias("relevant"))
    spine = truth.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    joined = spine.join(hits, "tier", "left").join(want, "tier", "left").na.fill(0)
    return joined.select("tier", "tp", "fp", "relevant", *micro(F.col("tp"), F.col("fp"), F.col("relevant")))


def sweep(evidence: DataFrame, screen: DataFrame, truth: DataFrame, queries: DataFrame, thresholds: list[int], views: list[int]) -> DataFrame:
    """Metrics for every (n_views, min_evidence) from stored evidence, in one pass over it."""
    spark = truth.sparkSession
    pairs = relevant_of(truth, queries)
    went = screen.where(F.col("stage2") != DIFFERENT).select("q", "c")
    counts = evidence.join(went, ["q", "c"], "left_semi").groupBy("q", "c").agg(*(F.count_if(is_evidence(F.col("reply")) & (F.col("view_idx") < n)).alias(f"v{n}") for n in views))
    flagged = counts.join(pairs.withColumn("is_rel", F.lit(True)), ["q", "c"], "left")
    long = flagged.select(F.coalesce("is_rel", F.lit(False)).alias("is_rel"), F.explode(F.array(*(F.struct(F.lit(n).alias("n_views"), F.col(f"v{n}").alias("e")) for n in views))).alias("x"))
    tally = long.groupBy("x.n_views", "x.e").agg(F.count_if(F.col("is_rel")).alias("tp"), F.count_if(~F.col("is_rel")).alias("fp"))
    grid = spark.createDataFrame([(n, t) for n in views for t in thresholds], "n_views int, min_evidence int")
    rows = grid.join(tally, "n_views", "left").groupBy("n_views", "min_evidence").agg(
        F.coalesce(F.sum(F.when(F.col("e") >= F.col("min_evidence"), F.col("tp"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("e") >= F.col("min_evidence"), F.col("fp"))), F.lit(0)).alias("fp"),
    )
    rows = rows.crossJoin(pairs.agg(F.count("*").alias("relevant")))
    return rows.select("n_views", "min_evidence", "tp", "fp", "relevant", *micro(F.col("tp"), F.col("fp"), F.col("relevant")))


def screen_quality(screen: DataFrame, truth: DataFrame, n_views: int) -> DataFrame:
    """Of what screening rejected: true and false negatives by same source, and the view calls it saved."""
    source = truth.select("model_id", "source_uid")
    gone = screen.where(F.col("stage2") == DIFFERENT).join(source.toDF("q", "sq"), "q").join(source.toDF("c", "sc"), "c")
    return gone.agg(F.count("*").alias("rejected"), F.count_if(F.col("sq") != F.col("sc")).alias("true_negatives"), F.count_if(F.col("sq") == F.col("sc")).alias("false_negatives"), (F.count("*") * n_views).alias("saved_calls"))


def nested(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query, confirmed_duplicates, rejected) with per-view details, for the sink."""
    angles = evidence.groupBy("q", "c").agg(F.array_sort(F.collect_list(F.struct("view_idx", F.col("reply").alias("result"), is_evidence(F.col("reply")).alias("evidence")))).alias("angle_details"))
    full = results.join(angles, ["q", "c"], "left")
    item = F.struct(F.round("sim", 6).alias("sim_score"), F.col("c").alias("candidate"), F.col("stage2").alias("stage2_result"), "evidence_count", F.when(F.col("outcome") != "confirmed", F.col("outcome")).alias("rejected_at"), F.when(F.col("stage2") != DIFFERENT, F.col("angle_details")).alias("angle_details"))
    pick = lambda ok: F.sort_array(F.collect_list(F.when((F.col("outcome") == "confirmed") == ok, item)), asc=False)
    return full.groupBy(F.col("q").alias("query")).agg(pick(True).alias("confirmed_duplicates"), pick(False).alias("rejected"))


def stage_rows(make: Callable[[], DataFrame], spark, path: str, resume: bool) -> DataFrame:
    """A stage's rows as written at path; with resume, a stage that was written whole is read, and its work not done again."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    if not (resume and done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_stages(candidates: DataFrame, views: DataFrame, judge: Callable[[], Judge], path: str, screen_prompt: str, angle_template: str, n_views: int, min_evidence: int, skip: bool = False, resume: bool = True, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """candidates (q, c, sim) through screening and view comparison; each stage's replies are written under path before they are used.

    views (model_id, view_idx, content) holds at most one row for each model
    and view. Screening compares view 0 of both models; a missing view is
    uncertain and asks nobody. Verification compares each of n_views angles; an
    angle of which a view is missing is SKIPPED, asks nobody and is no
    evidence. A judge answers once for each row of a stage that was written
    whole; a run that starts again reads what is there. Returns verified()'s rows.
    """
    spark = candidates.sparkSession
    asked = stage_rows(lambda: candidates.select("q", "c", "sim"), spark, f"{path}/candidates", resume)
    side = lambda v, s, name: v.select(F.col("model_id").alias(s), "view_idx", F.col("content").alias(name))

    def both(pairs: DataFrame) -> DataFrame:
        found = pairs.join(side(views, "q", "a"), ["q", "view_idx"], "left").join(side(views, "c", "b"), ["c", "view_idx"], "left")
        return found.withColumn("has_views", F.col("a").isNotNull() & F.col("b").isNotNull())

    def replies(pairs: DataFrame) -> DataFrame:
        got = ask(pairs.where("has_views"), judge, retries, wait)
        return got.drop("prompt", "a", "b").unionByName(pairs.where("not has_views").drop("prompt", "a", "b").withColumn("reply", F.lit(None).cast("string")))

    first = asked.withColumn("view_idx", F.lit(0))
    if skip:
        screen = screened(asked, skip=True)
    else:
        screen = screened(stage_rows(lambda: replies(both(first).withColumn("prompt", F.lit(screen_prompt))).drop("view_idx"), spark, f"{path}/screen", resume))
    went = screen.where(F.col("stage2") != DIFFERENT).select("q", "c")
    angles = went.withColumn("view_idx", F.explode(F.sequence(F.lit(0), F.lit(n_views - 1))))
    prompt = angle_prompt(angle_template, (F.col("view_idx") * F.lit(360) / F.lit(n_views)).cast("int"))
    evidence = stage_rows(lambda: replies(both(angles).withColumn("prompt", prompt)).withColumn("reply", F.when(F.col("has_views"), F.col("reply")).otherwise(F.lit(SKIPPED))), spark, f"{path}/evidence", resume)
    return verified(screen, evidence, n_views, min_evidence)


def compare(results: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(method, tier, tp, fp, relevant, precision, recall, f1): all retrieved candidates against those confirmed, overall ('all') and by tier."""
    out = None
    for method, flagged in (("embedding", results), ("rescorer", results.where("outcome = 'confirmed'"))):
        for part in (evaluate(flagged, truth, queries).withColumn("tier", F.lit("all")), evaluate_by_tier(flagged, truth, queries)):
            part = part.withColumn("method", F.lit(method))
            out = part if out is None else out.unionByName(part)
    return out.select("method", "tier", "tp", "fp", "relevant", "precision", "recall", "f1")
