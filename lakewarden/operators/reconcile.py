"""Before/after comparison of two tables.

Both sides go through one aggregation: rows are tagged with their side, grouped
by all their columns and counted.  Equal rows collapse before the shuffle, so
copies cost nothing, NULL equals NULL, and added and removed rows, as sets and
as bags, come out of the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """The named columns, cast to the types to compare by."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def normalize(df: DataFrame, upper: Sequence[str]) -> DataFrame:
    """Spell text columns in one case before comparing."""
    return df.withColumns({c: F.upper(c) for c in upper})


def schema_changes(spark: SparkSession, before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns on one side only (added, removed) and columns of another type (retyped)."""
    old, new = dict(before.dtypes), dict(after.dtypes)
    rows = [(c, "removed" if c not in new else "added" if c not in old else "retyped", old.get(c), new.get(c))
            for c in dict.fromkeys([*old, *new]) if old.get(c) != new.get(c)]
    return spark.createDataFrame(rows, "column string, change string, before_type string, after_type string")


def alike(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns they share, those of differing types as text.

    What this leaves out is the business of ``schema_changes``.
    """
    old, new = dict(before.dtypes), dict(after.dtypes)
    shared = [c for c in before.columns if c in new]

    def side(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if old[c] == new[c] else F.col(c).cast("string").alias(c) for c in shared])
    return side(before), side(after)


def row_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each distinct row with ``n_before`` and ``n_after``."""
    before, after = alike(before, after)
    columns = before.columns
    tagged = before.withColumn("_after", F.lit(0)).union(after.withColumn("_after", F.lit(1)))
    return tagged.groupBy(*columns).agg(
        F.sum(1 - F.col("_after")).alias("n_before"), F.sum("_after").alias("n_after"))


def set_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only, whatever their number, with ``change`` added or removed."""
    counts = row_counts(before, after)
    return (counts.filter("n_before = 0 or n_after = 0")
            .withColumn("change", F.when(F.col("n_before") == 0, "added").otherwise("removed"))
            .drop("n_before", "n_after"))


def bag_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose number of copies differs: ``change`` and by how many ``copies``."""
    gap = F.col("n_after") - F.col("n_before")
    return (row_counts(before, after).filter("n_before <> n_after")
            .withColumns({"change": F.when(gap > 0, "added").otherwise("removed"),
                          "copies": F.abs(gap)})
            .drop("n_before", "n_after"))


# Rows outside these many ranges are left out by a filter; more ranges are read whole.
MOST_RANGES = 256


def checksums(before: DataFrame, after: DataFrame, number: Column) -> DataFrame:
    """Per value of ``number`` whether the rows of both sides agree: ``number`` and ``differs``.

    Sums of two 64-bit hashes of the rows and their count, which no order changes and
    which combine before the shuffle: what moves is one row per range and task.  Halves
    of hashes are summed, so that nothing overflows.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        # Copies of a row with another type of hash each; NULLs differ by place.
        columns = [x for c in df.columns for x in (F.col(c), F.col(c).isNull())]
        parts = []
        for seed in (0, 1):
            h = F.xxhash64(F.lit(seed), *columns)
            parts += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
        return df.select(number.alias("number"), F.lit(sign).cast("bigint").alias("s0"),
                         *[(p * sign).alias(f"s{k}") for k, p in enumerate(parts, 1)])

    both = side(before, -1).unionAll(side(after, 1)).groupBy("number").agg(
        *[F.sum(f"s{k}").alias(f"s{k}") for k in range(5)])
    return both.select("number", F.greatest(*[F.abs(f"s{k}") for k in range(5)]).alias("gap")).select(
        "number", (F.col("gap") > 0).alias("differs"))


def differing_ranges(before: DataFrame, after: DataFrame, key: str, fanout: int = 64,
                     depth: int = 2) -> list[tuple[int, int]]:
    """Ranges of an integer key, both ends included, outside of which both tables hold the same rows.

    A tree of checksums: the range of all keys is cut into ``fanout`` ranges, those whose
    sums differ are cut again, and so on, each level reading only what still differs.
    The driver sees at most ``MOST_RANGES * fanout`` numbers; where more ranges differ,
    the descent ends, since little would be left out.
    """
    ends = before.select(key).unionAll(after.select(key)).agg(F.min(key), F.max(key)).first()
    if ends[0] is None:
        return []
    ranges = [(int(ends[0]), int(ends[1]))]
    width = ranges[0][1] - ranges[0][0] + 1
    for _ in range(depth):
        if width == 1 or len(ranges) > MOST_RANGES:
            break
        width = -(-width // fanout)
        number = F.call_function("div", F.col(key) - F.lit(int(ends[0])), F.lit(width))
        found = checksums(within(before, key, ranges), within(after, key, ranges), number).filter("differs")
        ranges = []
        for (k,) in sorted(found.select("number").collect()):
            low = int(ends[0]) + k * width
            if ranges and ranges[-1][1] == low - 1:
                ranges[-1] = (ranges[-1][0], low + width - 1)
            else:
                ranges.append((low, low + width - 1))
        if not ranges:
            break
    return ranges


def within(df: DataFrame, key: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """The rows of some ranges; the scan leaves out files and row groups that hold none."""
    if not ranges or len(ranges) > MOST_RANGES:
        return df.filter(F.col(key).isNotNull() & F.lit(bool(ranges)))
    outer = F.col(key).between(ranges[0][0], ranges[-1][1])
    return df.filter(outer & reduce(or_, [F.col(key).between(*r) for r in ranges]))


def range_diff(before: DataFrame, after: DataFrame, key: str, fanout: int = 64, depth: int = 2) -> DataFrame:
    """``bag_diff`` for tables that mostly agree: only rows of ranges that differ are shuffled.

    ``key`` is an integer column, best one the files are sorted by; rows without it are
    always compared.  Both sides are read ``depth`` times, but reduced to sums where they
    stand.
    """
    before, after = alike(before, after)
    ranges = differing_ranges(before, after, key, fanout, depth)
    sides = [within(df, key, ranges).unionAll(df.filter(F.col(key).isNull())) for df in (before, after)]
    return bag_diff(*sides)


def keyed_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What changed per key, for the keys whose rows differ.

    ``added`` and ``removed`` keys have rows on one side only; ``repeated`` keys
    hold the same values in another number of rows; ``changed`` keys list in
    ``changed_columns`` the columns in which some value gave way to another.
    Rows are never paired within a key, so a key with many rows stays linear.
    """
    values = [c for c in before.columns if c not in set(keys) and c in set(after.columns)]
    counts = row_counts(before, after)
    per_key = counts.groupBy(*keys).agg(
        F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"),
        F.bool_or(F.col("n_before") != F.col("n_after")).alias("_differs"))
    gap = F.col("n_after") - F.col("n_before")
    cells = counts.filter("n_before <> n_after").select(
        *keys, gap.alias("_gap"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"))
                            for c in values])).alias("_cell"))
    moved = (cells.groupBy(*keys, "_cell").agg(F.sum("_gap").alias("_net"))
             .groupBy(*keys, F.col("_cell.name").alias("_name"))
             .agg(((F.max("_net") > 0) & (F.min("_net") < 0)).alias("_moved"))
             .groupBy(*keys)
             .agg(F.sort_array(F.collect_list(F.when(F.col("_moved"), F.col("_name"))))
                  .alias("_columns")))
    left = per_key.filter("_differs").drop("_differs")
    right = moved.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_columns")
    joined = left.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], "left")
    change = (F.when(F.col("n_before") == 0, "added").when(F.col("n_after") == 0, "removed")
              .when(F.size("_columns") > 0, "changed").otherwise("repeated"))
    empty = F.array().cast("array<string>")
    return joined.select(
        *keys, "n_before", "n_after", change.alias("change"),
        F.when(change == "changed", F.coalesce("_columns", empty)).otherwise(empty)
        .alias("changed_columns"))


def report(spark: SparkSession, before: DataFrame, after: DataFrame, mode: str = "bag",
           upper: Sequence[str] = ()) -> DataFrame:
    """One row: schema, row count and value checks, and the overall status.

    Schemas match when names and types are equal in order.  Values are compared
    on the columns both sides have, as a ``set`` or a ``bag``; a column whose type
    differs is compared as text.
    """
    if mode not in ("set", "bag"):
        raise ValueError("mode is set or bag")
    schema_match = ([(f.name, f.dataType) for f in before.schema.fields]
                    == [(f.name, f.dataType) for f in after.schema.fields])
    shared = [c for c in before.columns if c in set(after.columns)]
    spelled = [c for c in upper if c in set(shared)]
    counts = row_counts(normalize(before.select(*shared), spelled),
                        normalize(after.select(*shared), spelled))
    if mode == "set":
        added = F.count_if(F.col("n_before") == 0)
        removed = F.count_if(F.col("n_after") == 0)
    else:
        added = _excess("n_after", "n_before")
        removed = _excess("n_before", "n_after")
    zero = F.lit(0).cast("bigint")
    out = counts.agg(
        F.coalesce(F.sum("n_before"), zero).alias("before_rows"),
        F.coalesce(F.sum("n_after"), zero).alias("after_rows"),
        F.coalesce(added, zero).alias("added_records"),
        F.coalesce(removed, zero).alias("removed_records"))
    out = out.select(
        F.lit(schema_match).alias("schema_match"),
        (F.col("before_rows") == F.col("after_rows")).alias("row_count_match"),
        ((F.col("added_records") == 0) & (F.col("removed_records") == 0)).alias("values_match"),
        "before_rows", "after_rows", "added_records", "removed_records")
    passed = F.col("schema_match") & F.col("row_count_match") & F.col("values_match")
    return out.withColumn("status", F.when(passed, "PASSED").otherwise("FAILED"))


def _excess(more: str, less: str) -> Column:
    return F.sum(F.greatest(F.col(more) - F.col(less), F.lit(0)))
