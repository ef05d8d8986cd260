"""Row rules: flag, correct, and count without dropping rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions import collections as C
from lakewarden.functions import exact


@dataclass(frozen=True)
class Rule:
    """A named condition on the rows, and optionally the columns that it corrects.

    ``broken`` is true for rows that break the rule; NULL counts as not broken.
    ``fix`` maps a column to its corrected value and is applied to every row.
    Rules run in order, so a later condition sees the values corrected before.
    """

    name: str
    broken: Callable[[], Column]
    fix: Callable[[], dict[str, Column]] | None = None

    @property
    def mark(self) -> str:
        return f"_broken_{self.name}"


def evaluate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add one marker column per rule and apply the corrections."""
    out = df
    for rule in rules:
        columns = {rule.mark: rule.broken()}
        if rule.fix is not None:
            columns.update(rule.fix())
        out = out.withColumns(columns)
    return out


def flags(rules: Sequence[Rule]) -> Column:
    """Names of the broken rules of a row, in rule order."""
    return C.flag_list([(r.name, F.col(r.mark)) for r in rules])


def collapse(df: DataFrame, rules: Sequence[Rule], into: str = "data_quality_flags") -> DataFrame:
    """Replace the marker columns by one joined text column."""
    return df.withColumn(into, C.joined_flags(flags(rules))).drop(*[r.mark for r in rules])


def apply(df: DataFrame, rules: Sequence[Rule], into: str = "data_quality_flags") -> DataFrame:
    return collapse(evaluate(df, rules), rules, into)


def broken_counts(marked: DataFrame, rules: Sequence[Rule], prefix: str = "") -> list[Column]:
    """Aggregates that count the broken rows of each rule."""
    return [F.count_if(F.col(r.mark)).alias(f"{prefix}{r.name.lower()}") for r in rules]


def clean_share(clean: Column, total: Column) -> Column:
    """Percentage of clean rows, 0 for an empty table."""
    return F.coalesce(exact.percentage(clean, total), F.lit(0).cast("decimal(28,2)"))
