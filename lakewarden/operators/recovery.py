"""Rebuild a table to its contract, and preview what that would discard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators import contract, dedup


def rebuild(df: DataFrame, expected: Sequence[str], keys: Sequence[str],
            as_text: Sequence[str] = (), prefer: Sequence[Column] | None = None) -> DataFrame:
    """Only the contract's columns, one row per key; fails when a column is missing.

    NULL is a key of its own.  Values are kept as they are, neither trimmed nor
    re-spelled; ``as_text`` names the columns to hold as text.  ``prefer`` may
    order the candidates by columns outside the contract.
    """
    contract.project(df, expected)  # fail before any work
    unique = dedup.one_per_key(df, keys, prefer) if prefer else dedup.one_per_key(
        df.select(*expected), keys)
    text = set(as_text)
    return unique.select(*[F.col(c).cast("string").alias(c) if c in text else F.col(c)
                           for c in expected])


def summary_by_country(silver: DataFrame) -> DataFrame:
    """Totals per country from the rebuilt table, in one aggregation."""
    return silver.groupBy("country").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("status") == "ACTIVE").alias("active_customers"),
        F.count_if(F.col("status") == "INACTIVE").alias("inactive_customers"))


def summary_by_country_joined(silver: DataFrame) -> DataFrame:
    """The same from two aggregates joined by country.

    Kept for comparison with tables built that way: rows without a country get
    NULL instead of their state counts, because NULL keys do not join.
    """
    totals = silver.groupBy("country").agg(F.count(F.lit(1)).alias("total_customers"))
    states = silver.groupBy("country").agg(
        F.count_if(F.col("status") == "ACTIVE").alias("active_customers"),
        F.count_if(F.col("status") == "INACTIVE").alias("inactive_customers"))
    return totals.join(states, "country", "left")


def preview(df: DataFrame, expected: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """What a rebuild would discard: ``kind``, ``name``, ``discarded``.

    One ``column`` row per column outside the contract with its number of
    non-NULL values, one ``rows`` row with the rows lost to key duplicates, and
    one ``missing`` row per contract column that blocks the rebuild.
    """
    known = set(expected)
    extra = [c for c in df.columns if c not in known]
    spark = df.sparkSession
    schema = "kind string, name string, discarded bigint"
    lost = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("discarded"))
    out = lost.select(F.lit("rows").alias("kind"), F.lit(",".join(keys)).alias("name"), "discarded")
    if extra:
        values = df.agg(*[F.count(c).alias(c) for c in extra]).unpivot(
            [], extra, "name", "discarded")
        out = values.select(F.lit("column").alias("kind"), "name", "discarded").union(out)
    missing = contract.missing_from(df, expected)
    if missing:
        out = out.union(spark.createDataFrame([("missing", m, None) for m in missing], schema))
    return out
