"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec, cotraining, embedding_dedup, packing, quality_rules, secret_scan, simhash_dedup, token_counts, toxicity, warc
from .base import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # source stands for the owner; an owner's documents in one language are a repository of its own.
    return secret_scan.report(table(spark, sf_dir, "documents"), "source", F.concat_ws("/", "source", "lang"))


def op8_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.round_trip(table(spark, sf_dir, "documents"))


def op10_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_lexical_packing": op5_lexical_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_cotraining": op8_quality_cotraining,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_warc_normaliser": op10_warc_normaliser,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op7_secret_scan": secret_scan.ORACLE_SQL,
    "op10_warc_normaliser": warc.ORACLE_SQL,
}
