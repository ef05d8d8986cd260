"""A training corpus from raw documents, in five stages.

Each stage reads what the one before it kept, and is written to the shared folder and
read again.  All but the last return the columns of ``documents``, whatever else those
are called.  Null texts count as empty and are judged, grouped and packed as such; rows
without an id are judged by their text, but never stand for others of a group; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakewarden.llm import exact_dedup, mixing, near_copies, packing, toxicity
from lakewarden.session import work_folder


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, learned from all labels of these documents, does not reject.

    Empty texts are scored like texts without a toxic word; repeated rows are judged alike.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts: the longest, of those the least id.

    All empty texts are one group.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_enough(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least id.

    Near are texts with a Jaccard similarity of 0.8 or more over five-word shingles,
    found by SimHash tries.  Texts without words are one group; rows without an id stay.
    """
    return near_copies.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Null is a source of its own; documents without words are never taken.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's words stand in the training sequences.

    A document that was taken several times is packed as often.
    """
    return packing.pack(docs)


STAGES = [("toxicity", not_toxic), ("exact_dedup", distinct_texts), ("simhash", distinct_enough), ("mixing", mixed),
          ("packing", packed)]
# Learned weights, hashed fingerprints and packing have no SQL; the tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
