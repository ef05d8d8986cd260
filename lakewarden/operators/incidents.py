"""Incident analytics: listing, root cause, investigation, lifecycle, memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import collections as C
from lakewarden.functions import columns as X
from lakewarden.operators import contract
from lakewarden.session import stored


def listing(incidents: DataFrame) -> DataFrame:
    """The fields of the incident list, by source file when it is known."""
    order = "source_file" if "source_file" in incidents.columns else "incident_id"
    return incidents.orderBy(order).select(
        "incident_id", "pipeline_name", "severity", "status", "error_type")


def evidence(incidents: DataFrame) -> DataFrame:
    """The evidence bundle of each incident."""
    return incidents.select("incident_id", "pipeline_name", "error_type", "affected_assets",
                            F.col("evidence").alias("schema_contract_evidence"), "root_cause")


def first_evidence(incidents: DataFrame) -> DataFrame:
    """The column lists of the first evidence item, as columns of the incident."""
    item = F.try_element_at("evidence", F.lit(1))
    names = ["expected_columns", "actual_columns", "unexpected_columns", "missing_columns"]
    return incidents.withColumns({n: item[n] for n in names})


# Root cause and investigation -------------------------------------------------

def root_cause(incidents: DataFrame,
               rules: Sequence[tuple[str, str, str, float]] = fixed.ROOT_CAUSES) -> DataFrame:
    """Add classification, cause and confidence; no rule means unknown with 0.

    The rules are a lookup in each row, so that a common error type is not
    gathered in one task.
    """
    def conclusion(label: str, text: str, certainty: float) -> Column:
        return F.struct(F.lit(label).alias("classification"), F.lit(text).alias("cause"),
                        F.lit(certainty).alias("confidence"))

    table = F.create_map(*[x for kind, *rest in rules for x in (F.lit(kind), conclusion(*rest))])
    found = F.coalesce(F.try_element_at(table, F.col("error_type")),
                       conclusion(*fixed.UNKNOWN_CAUSE))
    return incidents.withColumns({n: found[n] for n in ("classification", "cause", "confidence")})


def investigate(classified: DataFrame) -> DataFrame:
    """Status and confidence of the investigation of each incident.

    Needs ``classification``, ``cause``, ``confidence`` and the four column lists.
    ``investigation_reason`` is NO_EVIDENCE, INCOMPLETE_EVIDENCE or CONFLICTING_EVIDENCE
    and blocks it; an unknown cause completes it without a conclusion.  ``finding`` is
    the classification where there is one; the columns it rests on are
    ``reported_unexpected`` and ``reported_missing``.
    """
    audited = contract.audit_evidence(classified)
    none = F.col("expected_columns").isNull() & F.col("actual_columns").isNull()
    reason = (F.when(none, "NO_EVIDENCE")
              .when(F.col("evidence_state") == "malformed", "INCOMPLETE_EVIDENCE")
              .when(F.col("evidence_state") == "conflicting", "CONFLICTING_EVIDENCE"))
    unknown = (F.col("classification") == fixed.UNKNOWN_CAUSE[0]) | F.col("cause").isNull()
    certainty = F.when(F.col("confidence") >= fixed.RCA_HIGH_CONFIDENCE, "HIGH").otherwise("MEDIUM")
    open_end = reason.isNotNull() | unknown
    return audited.withColumns({
        "finding": F.when(~open_end, F.col("classification")),
        "investigation_status": F.when(reason.isNotNull(), "BLOCKED").otherwise("COMPLETED"),
        "investigation_confidence": F.when(open_end, "INSUFFICIENT_EVIDENCE").otherwise(certainty),
        "investigation_reason": reason,
    })


def citation_errors(results: DataFrame, cited: str = "cited", available: str = "available"
                    ) -> DataFrame:
    """Add the cited ids that are not available, and whether the citations are sound."""
    unknown = F.array_sort(F.array_except(cited, available))
    unique = F.size(F.array_distinct(cited)) == F.size(cited)
    return results.withColumns({
        "unknown_evidence": unknown,
        "citations_valid": F.coalesce((F.size(unknown) == 0) & unique, F.lit(False)),
    })


# Workflow ---------------------------------------------------------------------

def workflow_status(investigated: DataFrame, decisions: DataFrame, previews: DataFrame,
                    incident: str = "incident_key", strategy: str = "strategy_key") -> DataFrame:
    """Whether an incident waits for approval or is blocked.

    ``decisions`` has the audited ``status`` and the recommended strategy per
    incident; ``previews`` one row per incident and strategy with ``preview_status``.
    """
    chosen = decisions.select(incident, F.col(f"recommended_{strategy}").alias(strategy),
                              F.col("status").alias("strategy_status"))
    rows = (investigated.select(incident, "investigation_status")
            .join(chosen, incident, "left")
            .join(previews.select(incident, strategy, "preview_status"), [incident, strategy],
                  "left"))
    ready = ((F.col("investigation_status") == "COMPLETED")
             & (F.col("strategy_status") == "COMPLETED") & (F.col("preview_status") == "PASSED"))
    ready = F.coalesce(ready, F.lit(False))
    return rows.withColumns({
        "workflow_status": F.when(ready, "WAITING_FOR_HUMAN_APPROVAL").otherwise("BLOCKED"),
        "next_step": F.when(ready, "APPROVE").otherwise("UNBLOCK"),
    })


# Lifecycle --------------------------------------------------------------------

def lifecycle(events: DataFrame, incident: str = "incident_key", time: str = "ts") -> DataFrame:
    """When each incident reached each stage, from recorded events only.

    One row per incident with a time per stage, NULL where nothing was recorded.
    Sandbox verification is the first verification that passed; recovery
    verification is the last one, if it came after the execution.
    """
    passed = F.col("status") == "PASSED"
    needs_pass = {"approval_granted", "verification_completed"}

    def moments(action: str) -> Column:
        hit = F.col("action") == action
        return F.when(hit & passed if action in needs_pass else hit, F.col(time))

    times = {stage: F.min(moments(action)) for stage, action in fixed.LIFECYCLE_STAGES}
    times["RECOVERY_VERIFIED"] = F.max(moments("verification_completed"))
    out = events.groupBy(incident).agg(*[t.alias(s.lower()) for s, t in times.items()])
    return out.withColumn("recovery_verified", F.when(
        F.col("recovery_verified") > F.col("executed_sandbox"), F.col("recovery_verified")))


def timeline(stages: DataFrame, incident: str = "incident_key") -> DataFrame:
    """The stages as rows, in order, with the seconds since the last recorded stage."""
    names = [s for s, _ in fixed.LIFECYCLE_STAGES]
    items = F.array(*[F.struct(F.lit(i + 1).alias("stage_number"), F.lit(s).alias("stage"),
                               F.col(s.lower()).alias("reached_at")) for i, s in enumerate(names)])
    before = [F.greatest(*[F.col(n.lower()) for n in names[:i]], F.lit(None).cast("timestamp"))
              if i else F.lit(None).cast("timestamp") for i in range(len(names))]
    rows = stages.select(incident, F.posexplode(items).alias("_i", "_s"),
                         F.array(*before).alias("_before"))
    rows = rows.select(incident, "_s.*", F.col("_before")[F.col("_i")].alias("_prev"))
    gap = F.unix_micros("reached_at") - F.unix_micros("_prev")
    return (rows.filter(F.col("reached_at").isNotNull())
            .withColumn("seconds_since_previous", F.call_function("div", gap, F.lit(1_000_000)))
            .drop("_prev"))


def resolution(incidents: DataFrame, authorizations: DataFrame, executions: DataFrame,
               post_checks: DataFrame, data_checks: DataFrame,
               incident: str = "incident_key") -> DataFrame:
    """The resolved incident row, merged from its artifacts (one row each per incident)."""
    out = incidents
    for part in (authorizations, executions, post_checks, data_checks):
        out = out.join(part, incident, "left")
    done = ((F.col("post_execution_status") == "PASSED")
            & (F.col("data_verification_status") == "PASSED")
            & F.col("executed_at").isNotNull())
    return out.withColumn("resolution_status",
                          F.when(F.coalesce(done, F.lit(False)), "RESOLVED").otherwise("OPEN"))


def orphan_artifacts(artifacts: DataFrame, incidents: DataFrame,
                     incident: str = "incident_key") -> DataFrame:
    """Artifacts that name an incident which does not exist, with their number.

    Reduced to one row per incident and kind before the join.
    """
    named = artifacts.groupBy("artifact", incident).agg(F.count(F.lit(1)).alias("n_artifacts"))
    return named.join(incidents.select(incident).distinct(), incident, "left_anti")


# Memory -----------------------------------------------------------------------

def memory(incidents: DataFrame, *parts: DataFrame, incident: str = "incident_key") -> DataFrame:
    """One record per incident for reuse: what happened, what was done, did it hold.

    The other inputs have one row per incident; together they bring
    ``strategies_evaluated``, ``selected_strategy``, ``simulation_completed`` and
    ``controls_generated``.
    """
    rows = incidents
    for part in parts:
        rows = rows.join(part, incident, "left")
    verified = F.coalesce(F.col("post_execution_status") == "PASSED", F.lit(False))
    return rows.select(
        incident, "incident_id", F.col("error_type").alias("incident_type"),
        F.col("pipeline_name").alias("pipeline"), "root_cause",
        F.struct(
            "strategies_evaluated", "selected_strategy",
            F.coalesce("simulation_completed", F.lit(False)).alias("simulation_completed"),
            verified.alias("verification_completed"),
            F.col("post_execution_status").alias("verification_status")).alias("recovery"),
        F.struct("controls_generated").alias("prevention"),
        signature().alias("incident_signature"))


def signature(any_order: bool = False) -> Column:
    """What identifies a kind of incident: its error type and the unexpected columns.

    The order of the columns counts, unless ``any_order`` is set.
    """
    columns = F.coalesce("unexpected_columns", F.array().cast("array<string>"))
    return F.struct("error_type", (F.array_sort(columns) if any_order else columns)
                    .alias("unexpected_columns"))


def signature_tokens() -> Column:
    """A signature as a set, for near matches: the error type and each unexpected column."""
    kind = F.array_compact(F.array("error_type"))
    return F.array_union(kind, F.coalesce("unexpected_columns", F.array().cast("array<string>")))


def similar_groups(memories: DataFrame, incident: str = "incident_key") -> DataFrame:
    """Each incident with its signature and how many other incidents like it were verified.

    The partners themselves are the verified rows that share ``signature_id``; they
    are not listed per incident, which would grow with the square of a group.
    """
    rows = memories.select(
        incident, F.col("recovery.verification_completed").alias("verified"),
        C.fingerprint(F.col("incident_signature")).alias("signature_id"))
    groups = rows.groupBy("signature_id").agg(F.count_if("verified").alias("_verified_n"))
    return rows.join(stored(groups, "signatures"), "signature_id", "left").select(
        incident, "signature_id", "verified",
        (F.col("_verified_n") - F.col("verified").cast("bigint")).alias("similar_verified"))


def similar_to(memories: DataFrame, incident_id: str) -> DataFrame:
    """Verified incidents with the same signature as the given one, except itself."""
    mine = (memories.filter(F.col("incident_id") == incident_id)
            .agg(F.max(C.fingerprint(F.col("incident_signature"))).alias("_signature")))
    others = memories.filter((F.col("incident_id") != incident_id)
                             & F.col("recovery.verification_completed"))
    keyed = others.withColumn("_signature", C.fingerprint(F.col("incident_signature")))
    return keyed.join(F.broadcast(mine), "_signature", "left_semi").select(
        "incident_id", "incident_type", "pipeline",
        F.col("recovery.selected_strategy").alias("selected_strategy"))


# Prevention -------------------------------------------------------------------

def prevention_status(classified: DataFrame, keep: Sequence[str],
                      catalogue: Sequence[tuple[str, ...]] = fixed.PREVENTION_CONTROLS
                      ) -> DataFrame:
    """Whether prevention can be reviewed: only after a verified recovery, with controls.

    ``reason`` is NOT_VERIFIED or NO_CONTROLS where it cannot.
    """
    kinds = [kind for kind, *_ in catalogue]
    n = X.looked_up(F.col("classification"), {k: kinds.count(k) for k in dict.fromkeys(kinds)}, 0)
    verified = F.coalesce(F.col("post_execution_status") == "PASSED", F.lit(False))
    reason = F.when(~verified, "NOT_VERIFIED").when(n == 0, "NO_CONTROLS")
    return classified.select(
        *keep, F.when(reason.isNull(), "COMPLETED").otherwise("BLOCKED").alias("prevention_status"),
        F.when(reason.isNull(), n).otherwise(0).alias("n_controls"), reason.alias("reason"))


def controls(classified: DataFrame, keep: Sequence[str],
             catalogue: Sequence[tuple[str, str, str, str, str]] = fixed.PREVENTION_CONTROLS
             ) -> DataFrame:
    """Prevention controls of the incidents whose recovery was verified, one row each."""
    names = ("control_id", "control_name", "control_type", "trigger")
    known: dict[str, list[Column]] = {}
    for kind, *values in catalogue:
        known.setdefault(kind, []).append(
            F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)]))
    table = F.create_map(*[x for kind, rows in known.items() for x in (F.lit(kind), F.array(*rows))])
    verified = classified.filter(F.col("post_execution_status") == "PASSED")
    return verified.select(*keep, "classification",
                           F.inline(F.try_element_at(table, F.col("classification"))))
