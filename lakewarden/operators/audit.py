"""Audit events: valid and quarantined rows, scrubbing, history and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import collections as C
from lakewarden.functions import columns as X


def identifier_errors(df: DataFrame, incident: str | None = None, strategy: str | None = None,
                      actor: str | None = None) -> DataFrame:
    """Add ``invalid``: which of the identifier columns are missing or malformed."""
    wanted = [("incident_id", incident, fixed.INCIDENT_ID_PATTERN),
              ("strategy_id", strategy, fixed.STRATEGY_ID_PATTERN),
              ("actor", actor, fixed.ACTOR_NAME_PATTERN)]
    return df.withColumn("invalid", C.flag_list(
        [(label, ~X.matches(F.col(name), pattern)) for label, name, pattern in wanted if name]))


def action_errors(events: DataFrame, actions: Sequence[str] = fixed.AUDIT_ACTIONS) -> DataFrame:
    """Add ``invalid``: ``action`` for events with an unknown or missing action."""
    legal = F.coalesce(F.col("action").isin(list(actions)), F.lit(False))
    return events.withColumn("invalid", C.flag_list([("action", ~legal)]))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with the names of what was invalid."""
    broken = F.size("invalid") > 0
    return checked.filter(~broken).drop("invalid"), checked.filter(broken)


def scrubbed(events: DataFrame, details: str = "details") -> DataFrame:
    """Without detail entries that look like secrets."""
    return events.withColumn(details, C.scrub(F.col(details)))


def prepare(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events ready to append, and the quarantined ones; both scrubbed."""
    named = identifier_errors(scrubbed(events), incident="incident_id")
    legal = F.coalesce(F.col("action").isin(fixed.AUDIT_ACTIONS), F.lit(False))
    return split(named.withColumn("invalid", F.array_compact(F.concat(
        F.col("invalid"), F.array(F.when(~legal, F.lit("action")))))))


def trail(events: DataFrame, incident: str = "incident_id", time: str = "timestamp",
          tiebreak: str = "event_id") -> DataFrame:
    """Events of each incident, oldest first."""
    return events.orderBy(incident, time, tiebreak)


def counts(events: DataFrame, by: Sequence[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"))


def with_fingerprint(df: DataFrame, columns: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """SHA-256 over the named columns in name order."""
    parts: list[Column] = [F.col(c) for c in sorted(columns)]
    return df.withColumn(name, C.fingerprint(*parts))
