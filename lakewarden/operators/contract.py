"""Schema contracts: compare the columns of tables with what was agreed.

A schema is a small table with one row per column: ``table``, ``position``,
``column``, ``type``.  A contract is the same with ``allow_new_columns``.  Comparing
them reads no data; ``filled`` adds how many values each column holds, which says
what a drift or a rebuild would touch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import collections as C

SCHEMA_ROWS = "table string, position int, column string, type string, nullable boolean"
CONTRACT_ROWS = f"{SCHEMA_ROWS}, allow_new_columns boolean"


def schema_rows(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The columns of several tables, one row each."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.nullable)
            for name, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, SCHEMA_ROWS).coalesce(1)


def filled(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table and column the number of rows and of values, from one pass per table."""
    parts = []
    for name, df in tables.items():
        counted = df.agg(F.count(F.lit(1)).alias("_rows"),
                         *[F.count(F.col(c)).alias(c) for c in df.columns])
        parts.append(counted.unpivot(["_rows"], df.columns, "column", "non_null").select(
            F.lit(name).alias("table"), "column", F.col("_rows").alias("n_rows"), "non_null"))
    return reduce(DataFrame.union, parts)


def infer(spark: SparkSession, tables: Mapping[str, DataFrame],
          allow_new_columns: bool = False) -> DataFrame:
    """Take the present schemas as contracts."""
    return schema_rows(spark, tables).withColumn("allow_new_columns", F.lit(allow_new_columns))


def require_values(contract: DataFrame, values: DataFrame) -> DataFrame:
    """Mark the columns that hold a value in every row as required (``nullable`` false)."""
    return (contract.drop("nullable").join(values, ["table", "column"])
            .withColumn("nullable", F.col("non_null") < F.col("n_rows"))
            .drop("n_rows", "non_null"))


def declare(spark: SparkSession,
            agreed: Mapping[str, tuple[Sequence[str | tuple[str, str]], bool]]) -> DataFrame:
    """Contracts from (columns, allow_new_columns) per table; columns are names or
    (name, type) pairs."""
    rows = [(table, i, c if isinstance(c, str) else c[0], None if isinstance(c, str) else c[1],
             None, new)
            for table, (columns, new) in agreed.items() for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, CONTRACT_ROWS).coalesce(1)


def diff(schema: DataFrame, contract: DataFrame) -> DataFrame:
    """One row per column of either side with its state.

    ``unexpected``: only in the table; ``missing``: only in the contract;
    ``type_changed``: in both, and the contract names another type; else ``ok``.
    Names are compared as they are, also in case; position does not matter.
    """
    actual = schema.select("table", "column", F.col("type").alias("actual_type"),
                           F.lit(True).alias("_there"))
    agreed = contract.select("table", "column", F.col("type").alias("expected_type"),
                             F.lit(True).alias("_agreed"))
    state = (F.when(F.col("_agreed").isNull(), "unexpected")
             .when(F.col("_there").isNull(), "missing")
             .when(F.col("actual_type") != F.col("expected_type"), "type_changed")
             .otherwise("ok"))
    return (actual.join(agreed, ["table", "column"], "full")
            .select("table", "column", "actual_type", "expected_type", state.alias("state")))


def _names(state: str) -> Column:
    """Columns in one state, sorted; a table has few columns."""
    return F.sort_array(F.collect_list(F.when(F.col("state") == state, F.col("column"))))


def verdict(changes: DataFrame, contract: DataFrame, *totals: Column) -> DataFrame:
    """One row per table: the columns in each state and the verdict.

    Unexpected columns that are not allowed decide first, then missing ones; both
    lists are reported in any case.  ``totals`` are further aggregates of the changes.
    """
    rule = contract.groupBy("table").agg(F.bool_or("allow_new_columns").alias("allow_new_columns"))
    per_table = changes.groupBy("table").agg(
        _names("unexpected").alias("unexpected_columns"),
        _names("missing").alias("missing_columns"),
        _names("type_changed").alias("type_changed_columns"), *totals)
    drift = (F.size("unexpected_columns") > 0) & ~F.coalesce("allow_new_columns", F.lit(False))
    label = (F.when(drift, fixed.VERDICT_DRIFT)
             .when(F.size("missing_columns") > 0, fixed.VERDICT_MISSING)
             .otherwise(fixed.VERDICT_PASSED))
    return per_table.join(rule, "table", "left").withColumn("verdict", label)


def missing_from(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """Contract columns that the table lacks, in contract order."""
    there = set(df.columns)
    return [c for c in expected if c not in there]


def project(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exactly the contract's columns in its order; fails when one is missing."""
    missing = missing_from(df, expected)
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df.select(*expected)


# Evidence -------------------------------------------------------------------

def audit_evidence(evidence: DataFrame) -> DataFrame:
    """Check reported column differences against the column lists themselves.

    Needs array columns ``expected_columns``, ``actual_columns``,
    ``unexpected_columns`` and ``missing_columns``.  Lists that were not reported
    count as empty; without expected or actual columns the evidence is
    ``malformed``; a difference that does not follow from them is ``conflicting``.
    """
    empty = F.array().cast("array<string>")
    out = evidence.withColumns({
        "reported_unexpected": F.coalesce("unexpected_columns", empty),
        "reported_missing": F.coalesce("missing_columns", empty),
        "derived_unexpected": F.array_except("actual_columns", "expected_columns"),
        "derived_missing": F.array_except("expected_columns", "actual_columns"),
    })
    agrees = (C.same_members(F.col("derived_unexpected"), F.col("reported_unexpected"))
              & C.same_members(F.col("derived_missing"), F.col("reported_missing")))
    malformed = F.col("expected_columns").isNull() | F.col("actual_columns").isNull()
    return out.withColumn("evidence_state", F.when(malformed, "malformed")
                          .when(agrees, "consistent").otherwise("conflicting"))
