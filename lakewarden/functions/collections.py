"""Helpers for arrays and maps: flags, column lists, scrubbing, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewarden import fixed


def flag_list(conditions: Sequence[tuple[str, Column]]) -> Column:
    """Names of the conditions that are true, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions]))


def joined_flags(flags: Column) -> Column:
    """Flags joined with ``|``, or the clean label when there are none."""
    return F.when(F.size(flags) == 0, F.lit(fixed.CLEAN_LABEL)).otherwise(F.array_join(flags, "|"))


def column_list(text: Column) -> Column:
    """Comma-joined names as an array; empty text is an empty list, NULL stays NULL."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def same_members(left: Column, right: Column) -> Column:
    """Set equality: order and repeats do not matter."""
    return (F.size(F.array_except(left, right)) == 0) & (F.size(F.array_except(right, left)) == 0)


def length(items: Column) -> Column:
    """Number of items; an absent list has none."""
    return F.coalesce(F.size(items), F.lit(0))


def scrub(details: Column, hints: Sequence[str] = fixed.SECRET_HINTS) -> Column:
    """Drop top-level map entries whose key holds a secret hint, in any case."""
    pattern = "|".join(hints)
    return F.map_filter(details, lambda key, _: ~F.lower(key).rlike(pattern))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the JSON text of the columns, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
