"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm import (
    conversations,
    exact_dedup,
    fingerprints,
    language_id,
    line_dedup,
    mixing,
    packing,
    pii,
    runs,
    secret_scan,
    simhash,
    token_counts,
    toxicity,
)
from lakewarden.llm.text import fold


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _held_out(docs: DataFrame, folds: int, out: int) -> DataFrame:
    return docs.withColumn("held_out", F.coalesce(fold("doc_id", folds) == out, F.lit(False)))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language_id.fit(docs.filter(fold("doc_id", 3) != 1))
    return _held_out(language_id.identify(docs, model), 3, 1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_likeness(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold("doc_id", 5) != 0)
    return _held_out(toxicity.score(docs, toxicity.fit(docs, labels)), 5, 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(runs.periodic_runs(runs.with_repeats(_documents(spark, sf_dir))))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.repair_report(conversations.damaged(rows), rows.select("conv_id"))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_token_counts, op3_exact_dedup, op4_line_dedup, op5_mixing, op6_fingerprints, op7_packing,
    op8_secret_scan, op9_toxicity, op10_simhash, op11_periodic_runs, op12_pii, op13_conversation_repair)}
ORACLES = {"op3_exact_dedup": exact_dedup.SQL}
