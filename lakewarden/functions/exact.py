"""Exact rounding on decimals.

Sums and means of money are computed on whole units (cents and below) with
integer division, so results do not depend on the order of additions and halves
are always rounded away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _units(value: Column, scale: int) -> Column:
    """A decimal of the given scale as a whole number of its smallest units."""
    return (value * F.lit(10 ** scale).cast("decimal(20,0)")).cast("decimal(38,0)")


def half_up_quotient(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` as a whole number, halves away from zero.

    NULL when the denominator is NULL or zero.
    """
    num = numerator.cast("decimal(38,0)")
    den = F.nullif(denominator, F.lit(0)).cast("decimal(38,0)")
    size = F.call_function("div", (F.abs(num) * 2 + den).cast("decimal(38,0)"),
                           (den * 2).cast("decimal(38,0)"))
    return F.when(num < 0, -size).otherwise(size)


def rounded_sum(value: Column, scale: int, places: int) -> Column:
    """Sum of a decimal column of ``scale``, as decimal with ``places`` digits."""
    step = F.lit(10 ** (scale - places))
    return _as_decimal(half_up_quotient(_units(F.sum(value), scale), step), places)


def rounded_mean(value: Column, scale: int, places: int) -> Column:
    """Mean over non-NULL values, as decimal with ``places`` digits."""
    step = F.count(value) * (10 ** (scale - places))
    return _as_decimal(half_up_quotient(_units(F.sum(value), scale), step), places)


def percentage(part: Column, whole: Column, places: int = 2) -> Column:
    """``100 * part / whole`` of two counts, as decimal with ``places`` digits."""
    return _as_decimal(half_up_quotient(part * (100 * 10 ** places), whole), places)


def _as_decimal(units: Column, places: int) -> Column:
    """Whole number of 10^-places back to a decimal."""
    return (units.cast("decimal(28,0)") / F.lit(10 ** places).cast("decimal(9,0)")).cast(
        f"decimal(28,{places})")
