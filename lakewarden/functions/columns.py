"""Column helpers: cleaning, casting, clamping, ratios, buckets and dates.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import fixed


# Text -----------------------------------------------------------------------

def standardize(text: Column) -> Column:
    """Trimmed and upper-cased."""
    return F.upper(F.trim(text))


def or_label(text: Column, label: str) -> Column:
    """NULL becomes ``label``."""
    return F.coalesce(text, F.lit(label))


def accepted(value: Column, values: Sequence[str], fallback: str = fixed.UNKNOWN_LABEL) -> Column:
    """The value when it is in the list; ``fallback`` otherwise, also for NULL."""
    return F.when(value.isin(list(values)), value).otherwise(F.lit(fallback))


def is_email(text: Column) -> Column:
    """Never NULL: a missing address is not valid."""
    return F.coalesce(text.rlike(fixed.EMAIL_PATTERN), F.lit(False))


def matches(text: Column, pattern: str) -> Column:
    """Allow-list check of an identifier; NULL does not match."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


# Casts ----------------------------------------------------------------------

def typed(raw: Column, spark_type: str) -> Column:
    """Cast that yields NULL, not an error, for text that is no such value."""
    return raw.try_cast(spark_type)


# What a text must look like to be worth a cast; more than the casts accept.
_NUMBER = r"^[\x00-\x20+\-.0-9eE]+\z"
_BOOLEAN = r"(?i)^[\x00-\x20]*(t|true|y|yes|1|f|false|n|no|0)[\x00-\x20]*\z"
_LOOKS_LIKE = {"int": _NUMBER, "bigint": _NUMBER, "decimal": _NUMBER, "boolean": _BOOLEAN}


def typed_text(text: Column, spark_type: str) -> Column:
    """``typed`` for a text column.

    A failing cast raises and catches an exception inside the task, some
    microseconds per row; text that cannot be a value is sorted out before.
    """
    pattern = _LOOKS_LIKE.get(spark_type.split("(")[0])
    cast = text.try_cast(spark_type)
    return F.when(text.rlike(pattern), cast) if pattern else cast


def cast_failed(raw: Column, spark_type: str) -> Column:
    """True when a value is there and cannot be cast."""
    return raw.isNotNull() & raw.try_cast(spark_type).isNull()


def text_cast_failed(text: Column, spark_type: str) -> Column:
    """``cast_failed`` for a text column."""
    return text.isNotNull() & typed_text(text, spark_type).isNull()


# Numbers --------------------------------------------------------------------

def at_least(value: Column, low: int) -> Column:
    """Values under ``low`` are raised to it; NULL stays NULL."""
    return F.when(value < low, F.lit(low)).otherwise(value)


def within(value: Column, low: int, high: int) -> Column:
    """Clamp to [low, high]; NULL stays NULL."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def outside(value: Column, low: int, high: int) -> Column:
    return ~value.between(low, high)


def ratio_mismatch(stated: Column, total: Column, count: Column, tenths: int) -> Column:
    """True when ``stated`` differs from ``total / count`` by more than ``tenths``/10 of it.

    Multiplied out by ``count``, so that no division rounds; the bounds are
    inclusive.  Without a positive count there is nothing to compare; an unknown
    count leaves the answer unknown.
    """
    gap = F.abs(stated * count - total)
    return (count > 0) & (gap * 10 > total * tenths)


def looked_up(value: Column, table: Mapping[str, int], default: int) -> Column:
    """The number that ``table`` names for ``value``; ``default`` for any other or NULL.

    A chain of comparisons, which compiles to less code than a map literal.
    """
    hits = [(value == key, F.lit(number)) for key, number in table.items()]
    (first, number), *rest = hits
    return reduce(lambda c, h: c.when(*h), rest, F.when(first, number)).otherwise(F.lit(default))


def fx_thousandths(currency: Column, rates: Mapping[str, int] = fixed.FX_THOUSANDTHS) -> Column:
    """Thousandths of a dollar per unit; 1000 for an unknown or missing currency."""
    return looked_up(currency, rates, 1000)


def fx_from_table(rows: DataFrame, rates: DataFrame, currency: str = "currency") -> DataFrame:
    """The rows with ``rate_thousandths`` from a table of ``currency`` and ``thousandths``, and ``unknown_currency``.

    A currency without a rate, or none, counts as dollars, as in ``fx_thousandths``, but is
    marked.  Spark broadcasts the rates if they are small.  ``rates`` has one row per currency.
    """
    known = rates.select(F.col("currency").alias("_rated"), F.col("thousandths").cast("int").alias("_thousandths"))
    joined = rows.join(known, F.col(currency) == F.col("_rated"), "left")
    return joined.withColumns({
        "rate_thousandths": F.coalesce("_thousandths", F.lit(1000)),
        "unknown_currency": F.col("_thousandths").isNull()}).drop("_rated", "_thousandths")


def bucket(value: Column, bounds: Sequence[tuple[str, int]], floor: str) -> Column:
    """Label of the first bound that ``value`` reaches, from the top; NULL gets ``floor``."""
    (label, bound), *rest = bounds
    first = F.when(value >= bound, F.lit(label))
    chain = reduce(lambda c, b: c.when(value >= b[1], F.lit(b[0])), rest, first)
    return chain.otherwise(F.lit(floor))


def churn_label(score: Column) -> Column:
    return bucket(score, [("HIGH", fixed.CHURN_HIGH), ("MEDIUM", fixed.CHURN_MEDIUM)], "LOW")


def level_points(level: Column) -> Column:
    """Points of an ordinal level; an unknown or missing level counts as medium."""
    return looked_up(level, fixed.LEVEL_POINTS, fixed.UNRATED_POINTS)


# Dates ----------------------------------------------------------------------

def days_until(as_of: str, day: Column) -> Column:
    """Days from ``day`` to the fixed date ``as_of``; NULL when there is no day."""
    return F.date_diff(F.lit(as_of).cast("date"), day)
