"""Corpus cleaning in stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsight.llm import cotraining, packing, secret_scan, simhash_dedup, toxicity
from twinsight.llm.base import mark, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.filter_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, "source", F.concat_ws("/", "source", "lang"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", keep_good),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Learned classifiers, XXH64 and byte-pair encoding have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage but the last is written to the shared folder and read again, and what led to it is deleted."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, step in STAGES[:-1]:
        docs = settle(step(spark, docs, sf_dir), name, since)
    return STAGES[-1][1](spark, docs, sf_dir)
