"""Queries on incidents, approvals and the audit history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.operators import approvals, audit, incidents, risk, similarity
from lakewarden.plans import inputs
from lakewarden.plans.decision_queries import INVESTIGATED
from lakewarden.plans.oracle_inputs import over
from lakewarden.plans.shape import plain
from lakewarden.plans.trust_queries import evidence_lists
from lakewarden.session import stored, work_folder
from lakewarden.sources import sinks, tables

INCIDENT, STRATEGY = "incident_key", "strategy_key"
ASKED_INCIDENT = "INC-20240101-002"
NOW = "2024-02-01 00:00:00"


def _incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence_lists(inputs.incidents(spark, sf_dir))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.root_cause(_incidents(spark, sf_dir))


def investigated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.investigate(_classified(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.audit_events(spark, sf_dir)


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.decide(risk.score(inputs.strategies(spark, sf_dir)))


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(_decided(spark, sf_dir).select(
        INCIDENT, F.col("recommended_strategy_key").alias(STRATEGY)), "recommended")


# Identifiers, scrubbing, fingerprints -------------------------------------------

def id_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents whose id is malformed, and valid ones, side by side."""
    rows = inputs.incidents(spark, sf_dir).withColumns({
        "strategy_id": F.concat(F.lit("REC-"), F.lpad((F.col(INCIDENT) % 1001).cast("string"),
                                                      4, "0").substr(F.lit(2), F.lit(4))),
        "actor": F.when(F.col(INCIDENT) % 7 == 0, "root; drop").otherwise("Data Owner")})
    rows = rows.withColumn("strategy_id", F.when(F.col(INCIDENT) % 9 == 0, F.lower("strategy_id"))
                           .when(F.col(INCIDENT) % 17 == 0, F.concat("strategy_id", F.lit("\n")))
                           .otherwise(F.col("strategy_id")))
    good, bad = audit.split(audit.identifier_errors(rows, "incident_id", "strategy_id", "actor"))
    return plain(bad.select(INCIDENT, "incident_id", "invalid").unionByName(
        good.select(INCIDENT, "incident_id", F.array().cast("array<string>").alias("invalid"))))


def action_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type is no legal audit action, per type."""
    events = inputs.table(spark, sf_dir, "events")
    named = events.withColumn("action", F.when(
        F.col("event_type") == "purchase", "approval_granted").otherwise(F.col("event_type")))
    good, bad = audit.split(audit.action_errors(named))
    return (audit.counts(bad, ["action"]).withColumn("outcome", F.lit("quarantined"))
            .unionByName(audit.counts(good, ["action"]).withColumn("outcome", F.lit("valid"))))


def scrub_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event details without entries that look like secrets."""
    events = _events(spark, sf_dir)
    details = F.create_map(
        F.lit("props"), F.col("props"), F.lit("Api_Key"), F.col("actor"),
        F.lit("user_PASSWORD_hash"), F.col("actor"),
        F.when(F.col("event_id") % 2 == 0, "session_token").otherwise("session_name"),
        F.col("status"))
    kept = audit.scrubbed(events.withColumn("details", details))
    return kept.select("event_id", F.array_join(F.array_sort(F.map_keys("details")), ",")
                       .alias("keys"), F.map_contains_key("details", "session_name")
                       .alias("has_session"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.incidents(spark, sf_dir)
    return audit.with_fingerprint(rows, ["severity", "incident_id", "root_cause"]).select(
        INCIDENT, "fingerprint")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence ids that results cite, against the ids their incident has."""
    k = F.col(INCIDENT)
    ids = F.array(*[F.lit(f"EV-00{i}") for i in (1, 2, 3, 4)])
    rows = inputs.incidents(spark, sf_dir).select(
        INCIDENT,
        F.when(F.col("actual_columns").isNull(), F.array().cast("array<string>")).otherwise(ids)
        .alias("available"),
        F.when(k % 7 == 0, F.array(F.lit("EV-001"), F.lit("EV-001")))
        .when(k % 11 == 0, F.array(F.lit("EV-009"), F.lit("EV-002")))
        .otherwise(F.array(F.lit("EV-001"), F.lit("EV-004"))).alias("cited"))
    return plain(incidents.citation_errors(rows).select(INCIDENT, "unknown_evidence",
                                                        "citations_valid"))


# Incidents ----------------------------------------------------------------------

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incidents as nested documents."""
    item = F.struct(F.lit("SCHEMA_CONTRACT").alias("type"), "expected_columns", "actual_columns",
                    "unexpected_columns", "missing_columns")
    return _incidents(spark, sf_dir).select(
        "incident_id", "pipeline_name", "severity", F.lit("DETECTED").alias("status"),
        "error_type", F.array(F.lit("silver.customers"), F.col("pipeline_name"))
        .alias("affected_assets"), F.array(item).alias("evidence"), "root_cause")


def incident_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents stored as JSON documents, read back and listed."""
    folder = work_folder(spark, "incidents")
    _documents(spark, sf_dir).write.json(folder)
    return incidents.listing(tables.read_incidents(spark, folder, one_per_file=False))


def incident_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per supplier, stored as a JSON document in a file of its own, read back and listed."""
    folder = work_folder(spark, "incident-files")
    supplier = inputs.table(spark, sf_dir, "supplier")
    documents = supplier.select(
        F.concat(F.lit("SUP-"), F.col("s_suppkey").cast("string")).alias("incident_id"),
        F.lit("supplier_pipeline").alias("pipeline_name"),
        F.when(F.col("s_acctbal") < 0, "P1").otherwise("P3").alias("severity"),
        F.lit("DETECTED").alias("status"), F.lit("NEGATIVE_BALANCE").alias("error_type"),
        F.array("s_name").alias("affected_assets"))
    sinks.write_documents(documents, folder)
    return incidents.listing(tables.read_incidents(spark, folder))


def incident_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident documents of which some are cut off: those that parse, and a side table of the others."""
    folder = work_folder(spark, "incident-corrupt")
    whole = F.to_json(F.struct("*"))
    documents = _documents(spark, sf_dir).select("incident_id", whole.alias("text"))
    broken = F.right("incident_id", F.lit(1)) == "7"
    documents.select(F.when(broken, F.substring("text", 1, 60)).otherwise(F.col("text"))).write.text(folder)
    # Text files end in .txt; the reader takes documents by their ending.
    good, bad = tables.split_corrupt(tables.read_incidents(spark, folder, one_per_file=False, pattern="*.txt"))
    return good.select(F.lit("parsed").alias("outcome"), "incident_id", F.lit(None).cast("string").alias("text")).unionAll(
        bad.select(F.lit("corrupt"), F.regexp_extract("text", '"incident_id":"([^"]*)"', 1), "text"))


def event_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines of which some are cut off or no JSON at all, counted by outcome and day."""
    folder = work_folder(spark, "event-corrupt")
    events = _events(spark, sf_dir).filter(F.col("ts").isNotNull())
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("ts").alias("timestamp"),
                              "actor", "action", "status"), {"timestampFormat": sinks.MICROS})
    k = F.col("event_id")
    lines = events.select(F.when(k % 11 == 0, F.substring(line, 1, 25)).when(k % 13 == 0, "not json")
                          .when(k % 17 == 0, "").otherwise(line).alias("value"), F.to_date("ts").alias("event_date"))
    lines.write.partitionBy("event_date").text(folder)
    good, bad = tables.split_corrupt(tables.read_events(spark, folder, pattern="*.txt"))
    return good.groupBy(F.lit("parsed").alias("outcome"), "action").agg(F.count(F.lit(1)).alias("n")).unionAll(
        bad.groupBy(F.lit("corrupt"), F.when(F.col("text") == "not json", "text").otherwise("cut")).agg(
            F.count(F.lit(1))))


def evidence_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundle = incidents.evidence(_documents(spark, sf_dir))
    first = incidents.first_evidence(
        bundle.withColumnRenamed("schema_contract_evidence", "evidence"))
    return plain(first.drop("evidence"))


def rca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select(INCIDENT, "classification", "cause", "confidence")


def investigation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(investigated(spark, sf_dir).select(
        INCIDENT, "classification", "investigation_status", "investigation_confidence",
        "investigation_reason", "finding", "reported_unexpected", "reported_missing"))


# Approvals ----------------------------------------------------------------------

def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = inputs.incidents(spark, sf_dir).select(
        INCIDENT, (F.col("post_execution_status") == "PASSED").alias("verification_passed"))
    return approvals.approval_state(_events(spark, sf_dir), verified)


def approval_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_state(spark, sf_dir))


def approval_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approvals.latest_approval(inputs.incidents(spark, sf_dir).select(INCIDENT),
                                     _events(spark, sf_dir))


def _without_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents that carry no root cause; their recovery counts as executed already."""
    return inputs.incidents(spark, sf_dir).filter(F.col("root_cause").isNull()).select(INCIDENT)


def _authorized(spark: SparkSession, sf_dir: str, recommended: DataFrame,
                executed: bool = True, state: DataFrame | None = None) -> DataFrame:
    """One request per incident; some ask for another strategy than was approved."""
    approved = (state or _state(spark, sf_dir)).withColumnRenamed("decided_at", "approved_at").join(
        recommended, INCIDENT, "left")
    verified = inputs.incidents(spark, sf_dir).select(
        INCIDENT, F.col("post_execution_status").alias("verification_status"))
    requests = recommended.withColumn(STRATEGY, F.when(
        F.col(INCIDENT) % 10 == 4, F.lit(-1).cast("bigint")).otherwise(F.col(STRATEGY)))
    done = requests.join(_without_cause(spark, sf_dir), INCIDENT) if executed else None
    return approvals.authorize(requests, approved, verified, done)


def authorization_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_authorized(spark, sf_dir, _recommended(spark, sf_dir)))


def publish_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the recommended strategies against the authorization records."""
    asked = _recommended(spark, sf_dir)
    records = _authorized(spark, sf_dir, asked).filter("check_incident_match")
    done = asked.join(_without_cause(spark, sf_dir), INCIDENT)
    return approvals.publish_gate(asked, records, done, True, True)


def authorization_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of severities P1 and P3, run again for P1 and P2 after some were executed."""
    recommended, state = _recommended(spark, sf_dir), stored(_state(spark, sf_dir), "approvals")
    severity = inputs.incidents(spark, sf_dir).select(INCIDENT, "severity")

    def records(executed: bool, left_out: str) -> DataFrame:
        wanted = severity.filter(F.col("severity") != left_out).select(INCIDENT)
        return _authorized(spark, sf_dir, recommended, executed, state).join(wanted, INCIDENT)

    previous = records(False, "P2").withColumn(
        "authorized_at", F.lit("2024-01-15 00:00:00").cast("timestamp"))
    out = approvals.upsert_authorizations(previous, records(True, "P3"), NOW)
    return plain(out.select(INCIDENT, STRATEGY, "authorization_status", "execution_status",
                            "authorized_at"))


# History ------------------------------------------------------------------------

def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(incidents.lifecycle(_all_stages(spark, sf_dir)))


def _all_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit events with other actions for agent runs, so that stages fill up."""
    others = ["incident_detected", "rca_completed", "decision_generated", "execution_completed",
              "incident_resolved"]
    pick = F.element_at(F.array(*[F.lit(o) for o in others]),
                        (F.col("event_id") % 5 + 1).cast("int"))
    return _events(spark, sf_dir).withColumn("action", F.when(
        F.col("action") == "agent_invoked", pick).otherwise(F.col("action")))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(incidents.timeline(incidents.lifecycle(_all_stages(spark, sf_dir))))


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counts(_events(spark, sf_dir), [INCIDENT, "action", "status"])


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as JSON lines in two runs, read back oldest first, and those refused."""
    folder = work_folder(spark, "audit")
    events = _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("INC-20240101-"), F.lpad((F.col(INCIDENT) % 1000).cast("string"), 3, "0"))
        .alias("incident_id"), F.col("ts").alias("timestamp"), "actor",
        F.when(F.col("event_id") % 50 == 0, "unheard_of").otherwise(F.col("action"))
        .alias("action"), "status",
        F.create_map(F.lit("props"), F.col("props"), F.lit("token"), F.col("actor"))
        .alias("details"))
    valid, refused = audit.prepare(events)
    first = F.coalesce(F.col("timestamp") < F.lit("2024-01-16").cast("timestamp"), F.lit(False))
    for part in (first, ~first):
        sinks.append_events(valid.filter(part), folder)
        sinks.quarantine_events(refused.filter(part), folder)
    kept = audit.trail(tables.read_events(spark, folder)).withColumn("outcome", F.lit("stored"))
    held = audit.trail(tables.read_events(spark, f"{folder}-quarantine")).withColumn(
        "outcome", F.lit("quarantined"))
    return plain(kept.unionByName(held).select("outcome", "event_id", "incident_id", "timestamp", "actor", "action", "status",
                              F.col("details")["props"].alias("props"),
                              F.size("details").alias("n_details")))


def resolution_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with their authorization, execution and verification artifacts."""
    base = inputs.incidents(spark, sf_dir)
    records = _authorized(spark, sf_dir, _recommended(spark, sf_dir)).select(
        INCIDENT, STRATEGY, "authorization_status")
    ran = incidents.lifecycle(_all_stages(spark, sf_dir)).select(
        INCIDENT, F.col("executed_sandbox").alias("executed_at"))
    post = base.select(INCIDENT, F.col("post_execution_status").alias("post_execution_status"))
    data = base.filter(F.col("actual_columns").isNotNull()).select(
        INCIDENT, F.when(F.col("root_cause").isNull(), "FAILED").otherwise("PASSED")
        .alias("data_verification_status"))
    return plain(incidents.resolution(base.select(INCIDENT, "incident_id"), records, ran, post,
                                      data))


def orphan_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies and events that name an incident which is gone."""
    kept = inputs.incidents(spark, sf_dir).filter(F.col("root_cause").isNotNull())
    named = (inputs.strategies(spark, sf_dir).select(F.lit("strategy").alias("artifact"), INCIDENT)
             .union(_events(spark, sf_dir).select(F.lit("event").alias("artifact"), INCIDENT)))
    return incidents.orphan_artifacts(named, kept)


# Memory -------------------------------------------------------------------------

def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each incident; its strategies are aggregated in one pass."""
    scored = risk.score(inputs.strategies(spark, sf_dir))
    made = (incidents.controls(_classified(spark, sf_dir), [INCIDENT]).groupBy(INCIDENT)
            .agg(F.count(F.lit(1)).alias("controls_generated")))
    tried = risk.outcome(scored, {
        "strategies_evaluated": F.count(F.lit(1)),
        "simulation_completed": F.bool_or(F.col("data_loss_risk") != "HIGH")})
    return incidents.memory(_incidents(spark, sf_dir), tried.withColumnRenamed(
        f"best_{STRATEGY}", "selected_strategy"), made)


def memory_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory(spark, sf_dir).select(
        INCIDENT, "incident_id", "incident_type", "pipeline", "root_cause", "recovery.*",
        "prevention.controls_generated", "incident_signature.error_type",
        F.array_join("incident_signature.unexpected_columns", ",").alias("unexpected_columns"))


def similar_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.similar_groups(_memory(spark, sf_dir)).drop("signature_id")


def similar_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents of feeds with what is known of kinds that share 60 % of error type and columns."""
    rows = inputs.feed_incidents(spark, sf_dir).withColumn("tokens", incidents.signature_tokens())
    return similarity.near_classes(rows, INCIDENT, "tokens", "verified")


def similar_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verified incidents that are like one given incident."""
    return incidents.similar_to(_memory(spark, sf_dir), ASKED_INCIDENT)


def prevention_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.controls(_classified(spark, sf_dir), [INCIDENT])


def prevention_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.prevention_status(_classified(spark, sf_dir), [INCIDENT])


QUERIES = {
    "id_quarantine": id_quarantine,
    "action_quarantine": action_quarantine,
    "scrub_details": scrub_details,
    "fingerprint": fingerprint,
    "citations": citations,
    "incident_list": incident_list,
    "incident_files": incident_files,
    "incident_corrupt": incident_corrupt,
    "event_corrupt": event_corrupt,
    "evidence_bundle": evidence_bundle,
    "rca": rca,
    "investigation_status": investigation_status,
    "approval_state": approval_state,
    "approval_latest": approval_latest,
    "authorization_gate": authorization_gate,
    "publish_gate": publish_gate,
    "authorization_upsert": authorization_upsert,
    "lifecycle": lifecycle,
    "timeline": timeline,
    "audit_counts": audit_counts,
    "audit_trail": audit_trail,
    "resolution_merge": resolution_merge,
    "orphan_artifacts": orphan_artifacts,
    "memory_facts": memory_facts,
    "similar_incidents": similar_incidents,
    "similar_near": similar_near,
    "similar_partners": similar_partners,
    "prevention_controls": prevention_controls,
    "prevention_status": prevention_status,
}


# Oracles ------------------------------------------------------------------------

_STATE = """
, turns as (
  select *, action = 'approval_requested' as req,
    action = 'approval_rejected' and status <> 'BLOCKED' as rej,
    action = 'approval_granted' as apr
  from audit_events
  where action in ('approval_requested', 'approval_granted', 'approval_rejected')),
opened as (
  select *, coalesce(last_value(case when req or rej then req end ignore nulls) over (
    partition by incident_key order by ts, event_id
    rows between unbounded preceding and 1 preceding), false) as is_open,
    coalesce(last_value(case when req or rej then req and status = 'PASSED' end ignore nulls) over (
    partition by incident_key order by ts, event_id
    rows between unbounded preceding and 1 preceding), false) and coalesce(status, '') <> 'BLOCKED' as is_valid
  from turns),
folded as (
  select incident_key,
    min(ts) filter (where apr and is_open and is_valid) as t_apr,
    arg_min(actor, (ts, event_id)) filter (where apr and is_open and is_valid) as who_apr,
    max(ts) filter (where rej and is_open) as t_rej,
    arg_max(actor, (ts, event_id)) filter (where rej and is_open) as who_rej,
    max(ts) filter (where req) as t_req,
    arg_max(status = 'PASSED', (ts, event_id)) filter (where req) as asked,
    count(*) filter (where apr and is_open and not is_valid) as n_refused,
    count(*) filter (where action = 'approval_rejected' and status = 'BLOCKED') as n_blocked
  from opened group by incident_key),
judged as (
  select f.*, coalesce(i.post_execution_status = 'PASSED', false) as ok,
    case when t_apr is not null then 'APPROVED' when t_rej > t_req then 'REJECTED'
      when t_req is not null then 'PENDING' else 'NOT_REQUESTED' end as state
  from folded f left join incidents i on i.incident_key = f.incident_key),
approval_state as (
  select incident_key, state as approval_status,
    case state when 'APPROVED' then who_apr when 'REJECTED' then who_rej end as approved_by,
    case state when 'APPROVED' then t_apr when 'REJECTED' then t_rej end as decided_at,
    coalesce(asked, false) as approval_allowed, ok and state = 'APPROVED' as execution_allowed,
    n_blocked + n_refused as blocked_attempts
  from judged)
"""

_AUTHORIZED = _STATE + """
, requests as (
  select incident_key, case when incident_key % 10 = 4 then -1 else recommended_strategy_key end
    as strategy_key
  from decided),
checked as (
  select r.incident_key, r.strategy_key, a.approved_by, a.decided_at as approved_at,
    i.incident_key is not null and i.root_cause is null as done, i.severity,
    a.incident_key is not null as c1,
    a.incident_key is not null and coalesce(d.recommended_strategy_key = r.strategy_key, false)
      as c2,
    coalesce(i.post_execution_status = 'PASSED', false) as c3,
    coalesce(a.approval_status = 'APPROVED', false) as c4,
    coalesce(length(a.approved_by) > 0, false) as c5,
    coalesce(a.execution_allowed, false) as c6
  from requests r left join approval_state a on a.incident_key = r.incident_key
  left join decided d on d.incident_key = a.incident_key
  left join incidents i on i.incident_key = r.incident_key),
authorized as (
  select incident_key, strategy_key,
    case when c1 and c2 and c3 and c4 and c5 and c6 then 'AUTHORIZED' else 'BLOCKED' end
      as authorization_status,
    case when done then 'EXECUTED_SANDBOX' else 'NOT_EXECUTED' end as execution_status,
    approved_by, approved_at, severity, c1 as check_incident_match, c2 as check_strategy_match,
    c3 as check_verification_passed, c4 as check_approval_status, c5 as check_approved_by_present,
    c6 as check_execution_allowed
  from checked)
"""

_STAGES = """
, staged as (
  select incident_key, ts, status, case when action <> 'agent_invoked' then action
    else ['incident_detected', 'rca_completed', 'decision_generated', 'execution_completed',
          'incident_resolved'][event_id % 5 + 1] end as action
  from audit_events),
cycle as (
  select incident_key,
    min(ts) filter (where action = 'incident_detected') as detected,
    min(ts) filter (where action = 'rca_completed') as investigated,
    min(ts) filter (where action = 'decision_generated') as recovery_planned,
    min(ts) filter (where action = 'verification_completed' and status = 'PASSED')
      as sandbox_verified,
    min(ts) filter (where action = 'approval_granted' and status = 'PASSED') as human_approved,
    min(ts) filter (where action = 'execution_completed') as executed_sandbox,
    max(ts) filter (where action = 'verification_completed' and status = 'PASSED') as last_passed,
    min(ts) filter (where action = 'incident_resolved') as resolved
  from staged group by incident_key),
lifecycle as (
  select incident_key, detected, investigated, recovery_planned, sandbox_verified, human_approved,
    executed_sandbox, case when last_passed > executed_sandbox then last_passed end
      as recovery_verified, resolved
  from cycle)
"""

_MEMORY = """
, evaluated_n as (
  select incident_key, count(*) as n, bool_or(data_loss_risk <> 'HIGH') as sim
  from strategies group by incident_key),
memory as (
  select i.incident_key, i.incident_id, i.error_type as incident_type,
    i.pipeline_name as pipeline, i.root_cause, e.n as strategies_evaluated,
    d.recommended_strategy_key as selected_strategy, coalesce(e.sim, false) as simulation_completed,
    i.post_execution_status = 'PASSED' as verification_completed,
    i.post_execution_status as verification_status,
    case when i.error_type = 'SCHEMA_DRIFT' and i.post_execution_status = 'PASSED'
      then cast(4 as bigint) end as controls_generated,
    i.error_type, i.unexpected_columns
  from incidents i left join evaluated_n e on e.incident_key = i.incident_key
  left join decided d on d.incident_key = i.incident_key)
"""

_STAGE_NAMES = [s for s, _ in fixed.LIFECYCLE_STAGES]
_TIMELINE = "\nunion all\n".join(
    f"select incident_key, {i + 1} as stage_number, '{s}' as stage, {s.lower()} as reached_at, "
    + (f"greatest({', '.join(n.lower() for n in _STAGE_NAMES[:i])})" if i
       else "cast(null as timestamp)") + " as prev from lifecycle"
    for i, s in enumerate(_STAGE_NAMES))

ORACLES = {
    "id_quarantine": over("incidents", r"""
        , named as (
          select incident_key, incident_id,
            case when incident_key % 7 = 0 then 'root; drop' else 'Data Owner' end as actor,
            concat('REC-', substring(lpad(cast(incident_key % 1001 as varchar), 4, '0'), 2, 4)) as s
          from incidents),
        asked as (
          select *, case when incident_key % 9 = 0 then lower(s)
            when incident_key % 17 = 0 then concat(s, chr(10)) else s end as strategy_id from named)
        select incident_key, incident_id, concat_ws(',',
          case when not regexp_full_match(incident_id, 'INC-[0-9]{8}-[0-9]{3}')
            then 'incident_id' end,
          case when not regexp_full_match(strategy_id, 'REC-[0-9]{3}') then 'strategy_id' end,
          case when not regexp_full_match(actor, '[A-Za-z0-9 ._-]{1,64}') then 'actor' end)
          as invalid
        from asked"""),
    "action_quarantine": """
        select case when event_type = 'purchase' then 'approval_granted' else event_type end
            as action, count(*) as n_events,
          case when event_type = 'purchase' then 'valid' else 'quarantined' end as outcome
        from events group by event_type""",
    "scrub_details": """
        select event_id, case when event_id % 2 = 0 then 'props' else 'props,session_name' end
            as keys, event_id % 2 <> 0 as has_session
        from events""",
    "fingerprint": over("incidents", """
        select incident_key, sha256(concat('{"incident_id":"', incident_id, '","root_cause":',
          coalesce('"' || root_cause || '"', 'null'), ',"severity":"', severity, '"}'))
          as fingerprint
        from incidents"""),
    "citations": over("incidents", """
        , c as (
          select incident_key,
            case when actual_columns is null then [] else ['EV-001', 'EV-002', 'EV-003', 'EV-004']
              end as available,
            case when incident_key % 7 = 0 then ['EV-001', 'EV-001']
              when incident_key % 11 = 0 then ['EV-009', 'EV-002'] else ['EV-001', 'EV-004'] end
              as cited
          from incidents),
        u as (select *, list_sort(list_distinct([x for x in cited
          if not list_contains(available, x)])) as unknown from c)
        select incident_key, array_to_string(unknown, ',') as unknown_evidence,
          len(unknown) = 0 and len(list_distinct(cited)) = len(cited) as citations_valid
        from u"""),
    "incident_list": over("incidents", """
        select incident_id, pipeline_name, severity, 'DETECTED' as status, error_type
        from incidents"""),
    "incident_files": """
        select concat('SUP-', s_suppkey) as incident_id, 'supplier_pipeline' as pipeline_name,
          case when s_acctbal < 0 then 'P1' else 'P3' end as severity, 'DETECTED' as status,
          'NEGATIVE_BALANCE' as error_type
        from supplier""",
    "incident_corrupt": over("incidents", """
        , d as (select incident_id, severity from incidents)
        select 'parsed' as outcome, incident_id, cast(null as varchar) as text from d
        where right(incident_id, 1) <> '7'
        union all
        select 'corrupt', incident_id, substring(concat('{"incident_id":"', incident_id,
          '","pipeline_name":"customer_gold_pipeline","severity":"', severity), 1, 60)
        from d where right(incident_id, 1) = '7'"""),
    "event_corrupt": over("audit_events", """
        select case when event_id % 11 = 0 or event_id % 13 = 0 then 'corrupt' else 'parsed' end as outcome,
          case when event_id % 11 = 0 then 'cut' when event_id % 13 = 0 then 'text' else action end as action,
          count(*) as n
        from audit_events where ts is not null and (event_id % 11 = 0 or event_id % 13 = 0 or event_id % 17 <> 0)
        group by all"""),
    "evidence_bundle": over("incidents", """
        select incident_id, pipeline_name, error_type,
          'silver.customers,customer_gold_pipeline' as affected_assets, root_cause,
          expected_columns, actual_columns, unexpected_columns, missing_columns
        from incidents"""),
    "rca": over("incidents", """
        select incident_key, case when error_type = 'SCHEMA_DRIFT' then 'SCHEMA_CONTRACT_VIOLATION'
            else 'UNKNOWN' end as classification,
          case when error_type = 'SCHEMA_DRIFT' then 'Upstream source schema changed without an '
            || 'approved schema contract update.' else 'Unable to determine root cause.' end as cause,
          case when error_type = 'SCHEMA_DRIFT' then cast(1 as double) else cast(0 as double) end
            as confidence
        from incidents"""),
    "investigation_status": over("incidents", INVESTIGATED + "select * from investigated"),
    "approval_state": over("incidents audit_events", _STATE + "select * from approval_state"),
    "approval_latest": over("incidents audit_events", """
        select i.incident_key, coalesce(case l.a when 'approval_granted' then 'APPROVED'
          when 'approval_rejected' then 'REJECTED' end, 'PENDING') as approval_badge
        from incidents i left join (
          select incident_key, action as a, row_number() over (partition by incident_key
            order by ts desc, event_id desc) as rn
          from audit_events where action in ('approval_granted', 'approval_rejected')) l
          on l.incident_key = i.incident_key and l.rn = 1"""),
    "authorization_gate": over("incidents audit_events decided",
                               _AUTHORIZED
                               + "select * exclude (severity) from authorized"),
    "publish_gate": over("incidents audit_events decided", _AUTHORIZED + """
        , gate as (
          select d.incident_key, d.recommended_strategy_key as strategy_key,
            i.root_cause is null as already_published,
            case when a.incident_key is null then 'No authorization record found.'
              when a.strategy_key <> d.recommended_strategy_key
                then 'Authorization does not match the requested strategy.'
              when a.authorization_status <> 'AUTHORIZED' then 'Recovery is not authorized.'
              when not a.check_execution_allowed then 'Execution safety check failed.' end as why
          from decided d left join incidents i on i.incident_key = d.incident_key
          left join authorized a on a.incident_key = d.incident_key and a.check_incident_match)
        select incident_key, strategy_key, already_published,
          not already_published and why is null as publish_allowed,
          case when not already_published then why end as reason
        from gate"""),
    "authorization_upsert": over("incidents audit_events decided", _AUTHORIZED + """
        select incident_key, strategy_key, authorization_status,
          case when severity = 'P3' then 'NOT_EXECUTED' else execution_status end
            as execution_status,
          case when severity = 'P3' or (severity = 'P1' and execution_status = 'NOT_EXECUTED')
            then timestamp '2024-01-15' else timestamp '2024-02-01' end as authorized_at
        from authorized"""),
    "lifecycle": over("audit_events", _STAGES + "select * from lifecycle"),
    "timeline": over("audit_events", _STAGES + f"""
        select incident_key, stage_number, stage, reached_at,
          (epoch_us(reached_at) - epoch_us(prev) - case when reached_at < prev then
            -((epoch_us(prev) - epoch_us(reached_at)) % 1000000) else
            (epoch_us(reached_at) - epoch_us(prev)) % 1000000 end) // 1000000
            as seconds_since_previous
        from ({_TIMELINE}) where reached_at is not null"""),
    "audit_counts": over("audit_events", """
        select incident_key, action, status, count(*) as n_events from audit_events group by all"""),
    "audit_trail": over("audit_events", """
        select cast(event_id as varchar) as event_id,
          concat('INC-20240101-', lpad(cast(incident_key % 1000 as varchar), 3, '0')) as incident_id,
          ts as timestamp, actor, case when event_id % 50 = 0 then 'unheard_of' else action end as action,
          status, props, 1 as n_details,
          case when event_id % 50 = 0 then 'quarantined' else 'stored' end as outcome
        from audit_events"""),
    "resolution_merge": over("incidents audit_events decided", _AUTHORIZED + _STAGES + """
        select i.incident_key, i.incident_id, a.strategy_key, a.authorization_status,
          l.executed_sandbox as executed_at, i.post_execution_status,
          case when i.actual_columns is not null then case when i.root_cause is null then 'FAILED'
            else 'PASSED' end end as data_verification_status,
          case when i.post_execution_status = 'PASSED' and i.actual_columns is not null
            and i.root_cause is not null and l.executed_sandbox is not null then 'RESOLVED'
            else 'OPEN' end as resolution_status
        from incidents i left join authorized a on a.incident_key = i.incident_key
        left join lifecycle l on l.incident_key = i.incident_key"""),
    "orphan_artifacts": over("incidents strategies audit_events", """
        select artifact, incident_key, count(*) as n_artifacts
        from (select 'strategy' as artifact, incident_key from strategies union all
              select 'event', incident_key from audit_events)
        where incident_key not in (select incident_key from incidents
          where root_cause is not null)
        group by artifact, incident_key"""),
    "memory_facts": over("incidents strategies decided", _MEMORY + "select * from memory"),
    "similar_incidents": over("incidents strategies decided", _MEMORY + """
        select incident_key, verification_completed as verified,
          cast(count(*) filter (where verification_completed) over
            (partition by error_type, unexpected_columns)
            - case when verification_completed then 1 else 0 end as bigint) as similar_verified
        from memory"""),
    "similar_near": over("feed_tokens", """
        , kinds as (select incident_key, list_sort(list(token)) as tokens from feed_tokens group by all),
        rows as (select incident_key, tokens, o_orderpriority < '3' as ok
          from kinds join orders on o_orderkey = incident_key),
        classes as (select tokens, min(incident_key) as c, count(*) as n, count(*) filter (where ok) as v
          from rows group by tokens),
        parts as (select c, len(tokens) as n, unnest(tokens) as token from classes),
        common as (select a.c as a, b.c as b, count(*) as k, any_value(a.n) + any_value(b.n) as n
          from parts a join parts b on a.token = b.token and a.c <> b.c group by a.c, b.c),
        near as (select a, count(*) as near_classes, sum(v) as near_n
          from common join classes on c = b where 100 * k >= 60 * (common.n - k) group by a)
        select incident_key, c as representative, n as class_size,
          coalesce(near_classes, 0) as near_classes,
          cast(v + coalesce(near_n, 0) - cast(ok as int) as bigint) as near_verified
        from rows join classes on rows.tokens = classes.tokens left join near on a = c"""),
    "similar_partners": over("incidents strategies decided", _MEMORY + f"""
        select o.incident_id, o.incident_type, o.pipeline, o.selected_strategy
        from memory o, memory m
        where m.incident_id = '{ASKED_INCIDENT}' and o.incident_id <> m.incident_id
          and o.verification_completed and o.error_type = m.error_type
          and o.unexpected_columns = m.unexpected_columns"""),
    "prevention_controls": over("incidents", """
        select incident_key, 'SCHEMA_CONTRACT_VIOLATION' as classification, control_id,
          control_name, control_type, "trigger"
        from incidents, (values
          ('PREV-001', 'Schema Contract Enforcement', 'PREVENTION', 'Schema contract violation'),
          ('PREV-002', 'Schema Compatibility Test', 'TEST', 'Pipeline deployment'),
          ('PREV-003', 'Schema Drift Alert', 'MONITORING', 'Runtime schema inspection'),
          ('PREV-004', 'Deployment Gate', 'GOVERNANCE', 'CI/CD pipeline'))
          t(control_id, control_name, control_type, "trigger")
        where error_type = 'SCHEMA_DRIFT' and post_execution_status = 'PASSED'"""),
    "prevention_status": over("incidents", """
        select incident_key, case when post_execution_status = 'PASSED'
            and error_type = 'SCHEMA_DRIFT' then 'COMPLETED' else 'BLOCKED' end as prevention_status,
          case when post_execution_status = 'PASSED' and error_type = 'SCHEMA_DRIFT' then 4 else 0
            end as n_controls,
          case when post_execution_status <> 'PASSED'
            then 'NOT_VERIFIED' when error_type <> 'SCHEMA_DRIFT' then 'NO_CONTROLS' end as reason
        from incidents"""),
}
