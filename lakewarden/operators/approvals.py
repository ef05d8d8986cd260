"""Approval states, authorization and the publish gate, from event history.

Every gate is fail-closed: a missing value counts as false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.operators import scan

def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def approval_state(events: DataFrame, verified: DataFrame, incident: str = "incident_key",
                   time: str = "ts", order: str = "event_id") -> DataFrame:
    """Fold the approval events of each incident into its present state.

    A request opens the decision, and its own status says for good whether it may be
    approved: PASSED if the recovery had been verified by then.  The first rejection
    after it closes it until the next request.  The first approval while it is open
    sticks, if the request passed; otherwise, or if it was logged as BLOCKED itself, it
    is a blocked attempt, which counts whenever a request is open, and the decision
    stays open.  Decisions without an open request have no effect.  A rejection logged
    as BLOCKED is such an attempt, not a decision.  Execution also needs the
    verification to stand now.

    ``events`` has ``action``, ``status`` and ``actor``; ``verified`` one row per
    incident with ``verification_passed``.
    """
    action, status = F.col("action"), F.col("status")
    moment = F.struct(F.col(time), F.col(order))
    request = action == "approval_requested"
    reject = _holds((action == "approval_rejected") & (status != "BLOCKED"))
    approve = action == "approval_granted"
    blocked = _holds((action == "approval_rejected") & (status == "BLOCKED"))
    turns = events.filter(action.isin("approval_requested", "approval_granted",
                                      "approval_rejected"))
    passed = _holds(request & (status == "PASSED"))
    last_turn = F.when(request | reject, F.struct(
        moment.alias("at"), request.alias("open"), passed.alias("passed")))
    seen = scan.running_max(turns, [incident], [time, order], last_turn, "_before")
    open_ = _holds(F.col("_before.open"))
    grants = approve & open_
    valid = grants & _holds(F.col("_before.passed")) & ~_holds(status == "BLOCKED")
    who = F.struct(moment.alias("at"), F.col("actor"))
    folded = seen.groupBy(incident).agg(
        F.min(F.when(valid, who)).alias("_approve"),
        F.max(F.when(reject & open_, who)).alias("_reject"),
        F.max(F.when(request, moment)).alias("_request"),
        F.max(F.when(request, F.struct(moment, passed.alias("passed")))).alias("_asked"),
        F.count_if(grants & ~valid).alias("_refused_approvals"),
        F.count_if(blocked).alias("_blocked"))
    state = folded.join(verified.select(incident, "verification_passed"), incident, "left")
    approved = F.col("_approve").isNotNull()
    refused = _holds(F.col("_reject.at") > F.col("_request"))
    label = (F.when(approved, "APPROVED").when(refused, "REJECTED")
             .when(F.col("_request").isNotNull(), "PENDING").otherwise("NOT_REQUESTED"))
    chosen = F.when(approved, F.col("_approve")).when(refused, F.col("_reject"))
    return state.select(
        incident, label.alias("approval_status"),
        chosen["actor"].alias("approved_by"),
        chosen["at"][time].alias("decided_at"),
        _holds(F.col("_asked.passed")).alias("approval_allowed"),
        (approved & _holds(F.col("verification_passed"))).alias("execution_allowed"),
        (F.col("_blocked") + F.col("_refused_approvals")).cast("bigint").alias("blocked_attempts"))


def latest_approval(incidents: DataFrame, events: DataFrame, incident: str = "incident_key",
                    time: str = "ts", order: str = "event_id") -> DataFrame:
    """The badge: what the last approval event says, PENDING without one.

    A blocked attempt is logged as a rejection and shows as one.
    """
    last = (events.filter(F.col("action").isin("approval_granted", "approval_rejected"))
            .groupBy(incident).agg(F.max_by("action", F.struct(time, order)).alias("_last")))
    badge = (F.when(F.col("_last") == "approval_granted", "APPROVED")
             .when(F.col("_last") == "approval_rejected", "REJECTED").otherwise("PENDING"))
    return incidents.join(last, incident, "left").select(incident, badge.alias("approval_badge"))


def authorize(requests: DataFrame, approvals: DataFrame, verifications: DataFrame,
              executed: DataFrame | None = None, incident: str = "incident_key",
              strategy: str = "strategy_key") -> DataFrame:
    """Six checks per request; authorized only if all of them hold.

    ``requests`` has incident and strategy; ``approvals`` and ``verifications`` have
    one row per incident; ``executed`` lists what was already published.
    """
    granted = approvals.select(
        incident, F.col(strategy).alias("_approved_strategy"), "approval_status", "approved_by",
        "approved_at", F.col("execution_allowed").alias("_execution_allowed"),
        F.lit(True).alias("_has_approval"))
    rows = (requests.select(incident, strategy).distinct().join(granted, incident, "left")
            .join(verifications.select(incident, "verification_status"), incident, "left"))
    if executed is not None:
        done = executed.select(incident, strategy).distinct().withColumn("_done", F.lit(True))
        rows = rows.join(done, [incident, strategy], "left")
    else:
        rows = rows.withColumn("_done", F.lit(None).cast("boolean"))
    conditions = {
        "incident_match": F.col("_has_approval"),
        "strategy_match": F.col("_approved_strategy") == F.col(strategy),
        "verification_passed": F.col("verification_status") == "PASSED",
        "approval_status": F.col("approval_status") == "APPROVED",
        "approved_by_present": F.length("approved_by") > 0,
        "execution_allowed": F.col("_execution_allowed"),
    }
    checks = {f"check_{n}": _holds(c) for n, c in conditions.items()}
    out = rows.withColumns(checks)
    all_hold = F.array_min(F.array(*[F.col(c) for c in checks]))
    return out.select(
        incident, strategy,
        F.when(all_hold, "AUTHORIZED").otherwise("BLOCKED").alias("authorization_status"),
        F.when(_holds(F.col("_done")), "EXECUTED_SANDBOX").otherwise("NOT_EXECUTED")
        .alias("execution_status"),
        "approved_by", "approved_at", *checks)


def upsert_authorizations(previous: DataFrame, current: DataFrame, now: str,
                          incident: str = "incident_key",
                          strategy: str = "strategy_key") -> DataFrame:
    """Authorization records after another run at time ``now``.

    A record whose inputs are unchanged keeps its ``authorized_at``; records
    that were not asked for again stay as they are.
    """
    keys = [incident, strategy]
    values = [c for c in current.columns if c not in keys]
    compared = [c for c in values if c != "approved_by"]
    old = previous.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in [*values, "authorized_at"]],
                          F.lit(True).alias("_had"))
    both = current.withColumn("_has", F.lit(True)).join(old, keys, "full")
    same = F.col("_had").isNotNull() & F.col("_has").isNotNull()
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    keep_old = same | F.col("_has").isNull()
    return both.select(
        *keys,
        *[F.when(keep_old, F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        F.when(keep_old, F.col("_old_authorized_at")).otherwise(F.lit(now).cast("timestamp"))
        .alias("authorized_at"))


def publish_gate(requests: DataFrame, authorizations: DataFrame, published: DataFrame,
                 silver_present: bool, gold_present: bool,
                 scopes: Sequence[str] = fixed.ALLOWED_SCOPES, incident: str = "incident_key",
                 strategy: str = "strategy_key") -> DataFrame:
    """Whether each request may be published, and the first reason why not.

    Published requests are passed over before any check.  ``authorizations`` has
    one row per incident.
    """
    records = authorizations.select(
        incident, F.col(strategy).alias("_auth_strategy"), "authorization_status",
        F.col("check_execution_allowed").alias("_execution"), F.lit(True).alias("_record"))
    done = published.select(incident, strategy).distinct().withColumn("_done", F.lit(True))
    rows = (requests.select(incident, strategy).distinct().join(records, incident, "left")
            .join(done, [incident, strategy], "left"))
    failing = {
        "no_authorization": F.col("_record").isNull(),
        "incident_mismatch": F.col(incident).isNull(),
        "strategy_mismatch": ~_holds(F.col("_auth_strategy") == F.col(strategy)),
        "not_authorized": ~_holds(F.col("authorization_status") == "AUTHORIZED"),
        "execution_check_failed": ~_holds(F.col("_execution")),
        "scope_not_allowed": F.lit("SANDBOX_ONLY" not in scopes),
        "silver_missing": F.lit(not silver_present),
        "gold_missing": F.lit(not gold_present),
    }
    reasons = dict(fixed.PUBLISH_REASONS)
    first = F.coalesce(*[F.when(failing[name], F.lit(reasons[name]))
                         for name, _ in fixed.PUBLISH_REASONS])
    already = _holds(F.col("_done"))
    return rows.select(
        incident, strategy, already.alias("already_published"),
        (~already & first.isNull()).alias("publish_allowed"),
        F.when(~already, first).alias("reason"))
