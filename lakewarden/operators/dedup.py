"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orderable(df: DataFrame) -> list[str]:
    """The columns whose values have an order."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def latest_by_key(df: DataFrame, keys: Sequence[str], latest: Sequence[str],
                  tiebreak: Sequence[Column] | None = None) -> DataFrame:
    """The most recent row of each key; rows with a NULL in the key are dropped.

    A NULL in ``latest`` counts as oldest.  Ties are broken by ``tiebreak``, by
    default by all other columns, so the survivor is the same on every run.
    Spark keeps only one candidate per key and input partition before the
    shuffle (WindowGroupLimit), so a hot key costs one row per partition.
    """
    if tiebreak is None:
        rest = [c for c in orderable(df) if c not in set(keys) | set(latest)]
        tiebreak = [F.asc_nulls_last(c) for c in rest]
    order = [F.desc_nulls_last(c) for c in latest] + list(tiebreak)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    has_key = [F.col(k).isNotNull() for k in keys]
    out = df
    for condition in has_key:
        out = out.filter(condition)
    return out.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def one_per_key(df: DataFrame, keys: Sequence[str],
                prefer: Sequence[Column] | None = None) -> DataFrame:
    """One row per key; NULL is a key of its own.

    ``prefer`` orders the candidates; all columns decide what is left, so the
    survivor is fixed where a plain ``dropDuplicates`` would keep any.
    """
    rest = [F.asc_nulls_last(c) for c in orderable(df) if c not in set(keys)]
    order = [*(prefer or []), *rest] or [F.lit(1)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
