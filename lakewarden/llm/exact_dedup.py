"""Exact duplicates: 128-bit content hash, bytes compared within each hash, one row stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.text import id_and_text, numbered, restored, whole, without_spaces

TOP = "9223372036854775807"
# A length and an id as one number, which aggregates without sorting.
SCALE = "1" + 20 * "0"


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """Larger for longer texts, then for smaller ids; null without an id."""
    wide = lambda c: c.cast("decimal(38,0)")
    return (wide(n_chars) * F.lit(SCALE).cast("decimal(21,0)") + (F.lit(TOP).cast("decimal(20,0)") - wide(doc_id))
            ).cast("decimal(38,0)")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All columns, and beside them the group of each row."""
    text = whole(text_col)
    bare = without_spaces(text)
    rows = docs.withColumns({
        "__id": F.col(f"`{id_col}`").cast("long"), "__n": F.length(text),
        "__hash": F.unhex(F.md5(bare.cast("binary"))), "__sha": F.unhex(F.sha2(bare.cast("binary"), 256))})
    groups = (rows.select("__id", "__n", "__hash", bare.alias("__bare")).groupBy("__hash", "__bare")
              .agg(F.count("*").alias("__size"), F.max(_rank(F.col("__n"), F.col("__id"))).alias("__best"))
              .filter("__size > 1")
              .select("__hash", F.unhex(F.sha2(F.col("__bare").cast("binary"), 256)).alias("__sha"),
                      "__size", "__best"))
    joined = rows.join(groups, ["__hash", "__sha"], "left")
    return joined.withColumn("__kept", F.col("__best").isNull() | F.coalesce(
        _rank(F.col("__n"), F.col("__id")) == F.col("__best"), F.lit(False)))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row the row that stays of all rows with an equal text.

    Texts are equal when they are the same after all of ``[\\x20\\x09-\\x0D]`` is
    deleted; null counts as empty.  Of equal texts the one with the most code points
    stays, then the smallest id.  Rows are grouped by hash and by the text itself, so
    that texts of one hash are compared byte for byte, and copies within a partition
    become one row before anything moves.

    Returns one row per row: doc_id, keep_id, group_size, kept, text_sha256 (of the
    text without white space).  Rows without an id never stand for others: a group of
    only such rows has a null keep_id and keeps all.  Rows that repeat an id with
    its text are one document: each carries the same ``kept``.  Other columns are not
    read; an empty table gives an empty result.
    """
    best = (F.lit(TOP).cast("decimal(20,0)") - F.col("__best") % F.lit(SCALE).cast("decimal(21,0)")).cast("long")
    return _judged(id_and_text(docs, id_col, text_col), "doc_id", "text").select(
        F.col("__id").alias("doc_id"),
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(best).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).alias("group_size"), F.col("__kept").alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with, whatever their names."""
    rows, number, text = numbered(docs, id_col, text_col)
    return restored(_judged(rows, number, text).filter("__kept"), docs.columns)


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM t
"""
