"""Table checks.  Each check is one row: check, status, observed, expected."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import collections as C
from lakewarden.operators import reconcile, scan
from lakewarden.session import stored


# Detectors ------------------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with ``n`` rows."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def duplicate_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: number of repeated keys and of surplus rows."""
    zero = F.lit(0).cast("bigint")
    return duplicate_keys(df, keys).agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("surplus_rows"))


def null_counts(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column with its number of NULLs, from one pass."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    return counted.unpivot([], list(required), "column", "null_count")


def unaccepted_values(df: DataFrame, accepted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values outside the accepted ones, with their number of rows; NULL is one too."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"),
                 F.coalesce(F.col(c).isin(list(v)), F.lit(False)).alias("ok"))
        for c, v in accepted.items()])).alias("cell"))
    return (cells.filter(~F.col("cell.ok")).groupBy("cell.column", "cell.value")
            .agg(F.count(F.lit(1)).alias("n")))


def late_rows(df: DataFrame, keys: Sequence[str], arrival: Sequence[str], event_time: str,
              allowed: str = "0 seconds") -> DataFrame:
    """Rows whose event time lies behind the latest one that arrived before for the key.

    ``allowed`` is the lateness that is still accepted.  Adds ``seen_until``, the
    highest event time before the row, and the boolean ``late``.
    """
    out = scan.running_max(df, keys, arrival, F.col(event_time), "seen_until")
    bound = F.col("seen_until") - F.expr(f"interval '{allowed}'")
    return out.withColumn("late", F.coalesce(F.col(event_time) < bound, F.lit(False)))


def combined_failures(df: DataFrame, conditions: Sequence[tuple[str, Column]]) -> DataFrame:
    """How many rows fail each combination of conditions; rows that fail none are left out."""
    failed = df.select(C.flag_list(conditions).alias("flags"))
    return (failed.filter(F.size("flags") > 0)
            .groupBy(F.array_join("flags", "|").alias("failures"),
                     F.size("flags").alias("n_failures"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys without a parent, with their number of rows; NULL refers to nothing.

    The child is reduced to its distinct keys first, so a key that many rows
    share reaches the join as one row.
    """
    keys = (child.filter(F.col(child_key).isNotNull())
            .groupBy(F.col(child_key).alias("key")).agg(F.count(F.lit(1)).alias("n_rows")))
    known = parent.select(F.col(parent_key).alias("key")).distinct()
    return keys.join(known, "key", "left_anti")


# Checks ---------------------------------------------------------------------

def _row(check: str, passed: Column, observed: Column, expected: Column) -> list[Column]:
    ok = F.coalesce(passed, F.lit(False))
    return [F.lit(check).alias("check"), F.when(ok, "PASSED").otherwise("FAILED").alias("status"),
            observed.cast("string").alias("observed"), expected.cast("string").alias("expected")]


def check_contract(verdicts: DataFrame) -> DataFrame:
    broken = F.count_if(F.col("verdict") != fixed.VERDICT_PASSED)
    return verdicts.agg(broken.alias("n")).select(
        *_row("schema_contract", F.col("n") == 0, F.col("n"), F.lit(0)))


def check_row_count(df: DataFrame, baseline: DataFrame, tolerance: int = 0,
                    percent: int = 0) -> DataFrame:
    """Row counts of the table and its baseline differ by at most ``tolerance`` rows.

    ``percent`` of the baseline's rows are allowed too, whichever is more.
    """
    sides = df.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("bigint").alias("b")).union(
        baseline.agg(F.lit(0).cast("bigint"), F.count(F.lit(1))))
    return sides.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).select(
        *_row("row_count", F.abs(F.col("n") - F.col("b")) * 100 <= F.greatest(
            F.lit(tolerance * 100), F.col("b") * percent), F.col("n"), F.col("b")))


def check_nulls(df: DataFrame, required: Sequence[str]) -> DataFrame:
    found = df.agg(F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required]))
                   .alias("n"))
    return found.select(*_row("null_check", F.col("n") == 0, F.col("n"), F.lit(0)))


def check_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return duplicate_summary(df, keys).select(
        *_row("duplicate_check", F.col("surplus_rows") == 0, F.col("surplus_rows"), F.lit(0)))


def check_references(child: DataFrame, child_key: str, parent: DataFrame,
                     parent_key: str) -> DataFrame:
    lost = orphans(child, child_key, parent, parent_key).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0).cast("bigint")).alias("n"))
    return lost.select(*_row("referential_integrity", F.col("n") == 0, F.col("n"), F.lit(0)))


def check_rederived(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """A stored aggregate equals the one computed again from its source."""
    gaps = reconcile.bag_diff(stored, derived).agg(
        F.coalesce(F.sum("copies"), F.lit(0).cast("bigint")).alias("n"))
    return gaps.select(*_row("business_rules", F.col("n") == 0, F.col("n"), F.lit(0)))


def check_freshness(df: DataFrame, time: str, as_of: str, sla: str) -> DataFrame:
    """The latest time is not older than ``as_of`` minus ``sla`` (an interval text)."""
    bound = F.lit(as_of).cast("timestamp") - F.expr(f"interval '{sla}'")
    return df.agg(F.max(time).cast("timestamp").alias("t")).select(
        *_row("freshness", F.col("t") >= bound, F.col("t"), bound))


def check_table(df: DataFrame, baseline: DataFrame, required: Sequence[str], time: str, as_of: str,
                sla: str, tolerance: int = 0, percent: int = 0) -> DataFrame:
    """Row count, null check and freshness, as three rows from one pass over each table."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    zero = F.lit(0).cast("bigint")
    sides = df.agg(F.count(F.lit(1)).alias("n"), zero.alias("b"), F.count_if(missing).alias("m"),
                   F.max(time).cast("timestamp").alias("t")).union(
        baseline.agg(zero, F.count(F.lit(1)), zero, F.lit(None).cast("timestamp")))
    n, b, m, t = [F.col(c) for c in "nbmt"]
    bound = F.lit(as_of).cast("timestamp") - F.expr(f"interval '{sla}'")
    near = F.abs(n - b) * 100 <= F.greatest(F.lit(tolerance * 100), b * percent)
    found = sides.agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("m").alias("m"),
                      F.max("t").alias("t"))
    return found.select(F.inline(F.array(*[F.struct(*columns) for columns in (
        _row("row_count", near, n, b), _row("null_check", m == 0, m, F.lit(0)),
        _row("freshness", t >= bound, t, bound))])))


def check_all(df: DataFrame, baseline: DataFrame, key: str, required: Sequence[str], time: str, as_of: str, sla: str,
              child: DataFrame, child_key: str, group: str, amount: str, tolerance: int = 0,
              percent: int = 0) -> DataFrame:
    """Six checks of a table from one pass over it, its baseline and its child table.

    Row count against the baseline, NULLs in required columns, freshness, repeated keys,
    child rows without a parent, and totals per ``group`` (sum of ``amount`` and rows)
    against the baseline's, counted as rows of the totals that differ.  All three tables
    are reduced together to counts per key and group, which are stored; repeated keys
    and lost children follow from the counts per key, the totals from those per group.
    The results are those of the single checks.
    """
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    one, no = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    keys = {"k": F.col(key), "g": F.col(group)}
    sides = [
        df.select(*[c.alias(n) for n, c in keys.items()], one.alias("n"), no.alias("b"), no.alias("c"),
                  missing.cast("bigint").alias("m"), F.col(time).cast("timestamp").alias("t"),
                  F.col(amount).alias("now"), F.lit(None).alias("then")),
        baseline.select(*keys.values(), no, one, no, no, F.lit(None), F.lit(None), F.col(amount)),
        child.filter(F.col(child_key).isNotNull()).select(
            F.col(child_key), F.lit(None), no, no, one, no, F.lit(None), F.lit(None), F.lit(None))]
    counts = stored(reduce(DataFrame.unionAll, sides).groupBy("k", "g").agg(
        *[F.sum(x).alias(x) for x in "nbcm"], F.max("t").alias("t"), F.sum("now").alias("now"), F.sum("then").alias("then")),
        "counts")
    per_key = counts.groupBy("k").agg(*[F.sum(x).alias(x) for x in "nbcm"], F.max("t").alias("t"))
    n, b, m, t, twice, lost, off = map(F.col, ("n", "b", "m", "t", "twice", "lost", "off"))
    whole = per_key.agg(*[F.coalesce(F.sum(x), no).alias(x) for x in "nbm"], F.max("t").alias("t"),
                        F.coalesce(F.sum(F.greatest(n - 1, no)), no).alias("twice"),
                        F.coalesce(F.sum(F.when(n == 0, F.col("c"))), no).alias("lost"), no.alias("off"))
    per_group = counts.groupBy("g").agg(*[F.sum(x).alias(x) for x in ("n", "b", "now", "then")])
    same = (n == b) & F.col("now").eqNullSafe(F.col("then"))
    gaps = per_group.agg(F.coalesce(F.sum(F.when(same, 0).otherwise((n > 0).cast("bigint") + (b > 0).cast("bigint"))),
                                    no).alias("off"))
    found = whole.unionByName(gaps, allowMissingColumns=True).agg(
        *[F.sum(x).alias(x) for x in ("n", "b", "m", "twice", "lost", "off")], F.max("t").alias("t"))
    bound = F.lit(as_of).cast("timestamp") - F.expr(f"interval '{sla}'")
    near = F.abs(n - b) * 100 <= F.greatest(F.lit(tolerance * 100), b * percent)
    return found.select(F.inline(F.array(*[F.struct(*columns) for columns in (
        _row("row_count", near, n, b), _row("null_check", m == 0, m, F.lit(0)), _row("freshness", t >= bound, t, bound),
        _row("duplicate_check", twice == 0, twice, F.lit(0)), _row("referential_integrity", lost == 0, lost, F.lit(0)),
        _row("business_rules", off == 0, off, F.lit(0)))])))


def run(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks in one table."""
    return reduce(DataFrame.unionByName, checks)


def overall(results: DataFrame) -> DataFrame:
    """One row: checks run, failed checks and the overall status (fails without checks)."""
    failed = F.count_if(F.col("status") != "PASSED")
    return results.agg(F.count(F.lit(1)).alias("checks_run"), failed.alias("failed_checks")).select(
        "checks_run", "failed_checks",
        F.when((F.col("failed_checks") == 0) & (F.col("checks_run") > 0), "PASSED")
        .otherwise("FAILED").alias("verification_status"))


