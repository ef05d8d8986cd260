"""Approvals, gates, incidents, audit events and stored files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.operators import approvals, audit, incidents
from lakewarden.sources import sinks, tables, versions

ASK, YES, NO = "approval_requested", "approval_granted", "approval_rejected"


def log(spark, *steps):
    """Events of incident 1, a minute apart: (action, status, actor)."""
    data = [(i, 1, a, s, w) for i, (a, s, w) in enumerate(steps)]
    return spark.createDataFrame(data, "event_id int, incident_key int, action string, "
                                 "status string, actor string").withColumn(
        "ts", F.timestamp_seconds(F.col("event_id") * 60))


def state(spark, steps, passed=True):
    verified = spark.createDataFrame([(1, passed)], "incident_key int, verification_passed boolean")
    return approvals.approval_state(log(spark, *steps), verified).collect()


@pytest.mark.parametrize("steps,passed,want", [
    ([(ASK, "PASSED", "x")], True, ("PENDING", None, 0)),
    ([(ASK, "PASSED", "x"), (YES, "PASSED", "ann")], True, ("APPROVED", "ann", 0)),
    ([(ASK, "PASSED", "x"), (YES, "PASSED", "ann"), (YES, "PASSED", "bob"), (NO, "REJECTED", "cy")],
     True, ("APPROVED", "ann", 0)),
    ([(ASK, "PASSED", "x"), (NO, "REJECTED", "bob"), (YES, "PASSED", "ann")], True,
     ("REJECTED", "bob", 0)),
    ([(ASK, "PASSED", "x"), (NO, "REJECTED", "bob"), (NO, "REJECTED", "cy")], True,
     ("REJECTED", "bob", 0)),
    ([(ASK, "PASSED", "x"), (NO, "REJECTED", "bob"), (ASK, "PASSED", "x")], True,
     ("PENDING", None, 0)),
    ([(ASK, "PASSED", "x"), (NO, "REJECTED", "bob"), (ASK, "PASSED", "x"), (YES, "PASSED", "ann")],
     True, ("APPROVED", "ann", 0)),
    ([(ASK, "PASSED", "x"), (NO, "BLOCKED", "ann"), (YES, "PASSED", "ann")], True,
     ("APPROVED", "ann", 1)),
    ([(ASK, "PASSED", "x"), (YES, "PASSED", "ann")], False, ("APPROVED", "ann", 0)),
    ([(ASK, "BLOCKED", "x"), (YES, "PASSED", "ann")], None, ("PENDING", None, 1)),
    ([(ASK, "BLOCKED", "x"), (YES, "PASSED", "ann"), (ASK, "PASSED", "x"), (YES, "PASSED", "bob")], True,
     ("APPROVED", "bob", 1)),
    ([(YES, "PASSED", "ann")], True, ("NOT_REQUESTED", None, 0)),
])
def test_approval_fold(spark, steps, passed, want):
    got = state(spark, steps, passed)[0]
    assert (got.approval_status, got.approved_by, got.blocked_attempts) == want
    assert got.execution_allowed is (want[0] == "APPROVED" and passed is True)


def test_latest_badge(spark, rows):
    asked = spark.createDataFrame([(1,), (2,)], "incident_key int")
    events = log(spark, (YES, "PASSED", "a"), (NO, "BLOCKED", "a"), (ASK, "PASSED", "a"))
    assert rows(approvals.latest_approval(asked, events)) == [(1, "REJECTED"), (2, "PENDING")]


GOOD = {"strategy_key": 7, "approval_status": "APPROVED", "approved_by": "ann",
        "execution_allowed": True, "verification_status": "PASSED"}


def gate(spark, now="2024-01-01", previous=None, **changes):
    v = {**GOOD, **changes}
    request = spark.createDataFrame([(1, 7)], "incident_key int, strategy_key int")
    approved = spark.createDataFrame(
        [(1, v["strategy_key"], v["approval_status"], v["approved_by"], None, v["execution_allowed"])],
        "incident_key int, strategy_key int, approval_status string, approved_by string, "
        "approved_at timestamp, execution_allowed boolean")
    verified = spark.createDataFrame([(1, v["verification_status"])],
                                     "incident_key int, verification_status string")
    return request, approvals.authorize(request, approved, verified)


def test_gate_opens_only_if_all_hold(spark):
    assert gate(spark)[1].collect()[0].authorization_status == "AUTHORIZED"
    for name, bad in {"strategy_key": 8, "approval_status": "PENDING", "approved_by": "",
                      "execution_allowed": False, "verification_status": "FAILED"}.items():
        for value in (bad, None):
            assert gate(spark, **{name: value})[1].collect()[0].authorization_status == "BLOCKED"


def test_gate_without_any_approval(spark):
    request, records = gate(spark)
    none = records.sparkSession.createDataFrame(
        [], "incident_key int, strategy_key int, approval_status string, approved_by string, "
            "approved_at timestamp, execution_allowed boolean")
    verified = spark.createDataFrame([(1, "PASSED")], "incident_key int, verification_status string")
    got = approvals.authorize(request, none, verified).collect()[0]
    assert got.authorization_status == "BLOCKED" and got.check_incident_match is False


def test_publish_gate_names_the_first_reason(spark):
    request, records = gate(spark)
    nobody = request.limit(0)

    def reason(auth, done=nobody, silver=True, gold=True, scopes=("SANDBOX_ONLY",)):
        r = approvals.publish_gate(request, auth, done, silver, gold, scopes).collect()[0]
        return r.publish_allowed, r.reason, r.already_published

    texts = dict(fixed.PUBLISH_REASONS)
    assert reason(records) == (True, None, False)
    assert reason(records.limit(0)) == (False, texts["no_authorization"], False)
    assert reason(records.withColumn("strategy_key", F.lit(9))) \
        == (False, texts["strategy_mismatch"], False)
    blocked = gate(spark, approval_status="PENDING", execution_allowed=False)[1]
    assert reason(blocked) == (False, texts["not_authorized"], False)
    assert reason(records.withColumn("check_execution_allowed", F.lit(None).cast("boolean"))) \
        == (False, texts["execution_check_failed"], False)
    assert reason(records, scopes=()) == (False, texts["scope_not_allowed"], False)
    assert reason(records, silver=False, gold=False) == (False, texts["silver_missing"], False)
    assert reason(records, gold=False) == (False, texts["gold_missing"], False)
    assert reason(records.limit(0), done=request) == (False, None, True)


def test_upsert_keeps_the_time_of_unchanged_records(spark, rows):
    _, records = gate(spark)
    empty = records.limit(0).withColumn("authorized_at", F.lit(None).cast("timestamp"))
    first = approvals.upsert_authorizations(empty, records, "2024-01-01")
    again = approvals.upsert_authorizations(first, records, "2024-02-02")
    assert again.collect()[0].authorized_at == dt.datetime(2024, 1, 1)
    changed = records.withColumn("execution_status", F.lit("EXECUTED_SANDBOX"))
    assert approvals.upsert_authorizations(first, changed, "2024-02-02").collect()[0] \
        .authorized_at == dt.datetime(2024, 2, 2)
    kept = approvals.upsert_authorizations(first, records.limit(0), "2024-02-02").collect()
    assert len(kept) == 1 and kept[0].authorized_at == dt.datetime(2024, 1, 1)


# Incidents ----------------------------------------------------------------------

LISTS = ", ".join(f"{n}_columns array<string>" for n in
                  ("expected", "actual", "unexpected", "missing"))


@pytest.mark.parametrize("error,lists,status,confidence", [
    ("SCHEMA_DRIFT", (["a"], ["a", "b"], ["b"], None), "COMPLETED", "HIGH"),
    ("OTHER", (["a"], ["a", "b"], ["b"], None), "COMPLETED", "INSUFFICIENT_EVIDENCE"),
    ("SCHEMA_DRIFT", (["a"], ["a", "b"], [], None), "BLOCKED", "INSUFFICIENT_EVIDENCE"),
    ("SCHEMA_DRIFT", (["a"], None, [], None), "BLOCKED", "INSUFFICIENT_EVIDENCE"),
    ("SCHEMA_DRIFT", (None, None, None, None), "BLOCKED", "INSUFFICIENT_EVIDENCE"),
    (None, (["a"], ["a"], [], []), "COMPLETED", "INSUFFICIENT_EVIDENCE")])
def test_investigation(spark, error, lists, status, confidence):
    df = spark.createDataFrame([(error, *lists)], f"error_type string, {LISTS}")
    got = incidents.investigate(incidents.root_cause(df)).collect()[0]
    assert (got.investigation_status, got.investigation_confidence) == (status, confidence)


def test_weaker_causes_have_medium_confidence(spark):
    df = spark.createDataFrame([("LATE", ["a"], ["a"], [], [])], f"error_type string, {LISTS}")
    rules = [*fixed.ROOT_CAUSES, ("LATE", "LATE_DATA", "Late.", 0.5)]
    got = incidents.investigate(incidents.root_cause(df, rules)).collect()[0]
    assert got.investigation_confidence == "MEDIUM" and got.classification == "LATE_DATA"


def test_citations(spark, rows):
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["a", "a"], ["a"]), (["z"], ["a"]), (None, ["a"])],
                               "cited array<string>, available array<string>")
    assert [r.citations_valid for r in incidents.citation_errors(df).collect()] \
        == [True, False, False, False]


def test_lifecycle_uses_recorded_events_only(spark, rows):
    events = log(spark, ("incident_detected", "PASSED", "x"), ("verification_completed", "PASSED", "x"),
                 (YES, "BLOCKED", "x"), (YES, "PASSED", "x"), ("execution_completed", "PASSED", "x"),
                 ("verification_completed", "PASSED", "x"))
    stages = incidents.lifecycle(events)
    got = rows(incidents.timeline(stages), "stage_number", "stage", "seconds_since_previous")
    assert got == [(1, "DETECTED", None), (4, "SANDBOX_VERIFIED", 60), (5, "HUMAN_APPROVED", 120),
                   (6, "EXECUTED_SANDBOX", 60), (7, "RECOVERY_VERIFIED", 60)]
    before = incidents.lifecycle(events.filter("event_id < 5")).collect()[0]
    assert before.recovery_verified is None and before.resolved is None


def memories(spark, *records):
    df = spark.createDataFrame([(i, f"INC-{i}", e, "p", "why", u, p) for i, e, u, p in records],
                               "incident_key int, incident_id string, error_type string, "
                               "pipeline_name string, root_cause string, "
                               "unexpected_columns array<string>, post_execution_status string")

    def side(columns):
        return spark.createDataFrame([], f"incident_key int, {columns}")
    return incidents.memory(df, side("strategies_evaluated bigint"), side("selected_strategy string"),
                            side("simulation_completed boolean"), side("controls_generated bigint"))


def test_similar_incidents(spark, rows):
    mem = memories(spark, (1, "D", ["a", "b"], "PASSED"), (2, "D", ["a", "b"], "PASSED"),
                   (3, "D", ["a", "b"], "FAILED"), (4, "D", ["b", "a"], "PASSED"),
                   (5, "E", ["a", "b"], None), (6, "D", None, "PASSED"), (7, "D", [], "PASSED"))
    assert rows(incidents.similar_groups(mem), "incident_key", "similar_verified") == [
        (1, 1), (2, 1), (3, 2), (4, 0), (5, 0), (6, 1), (7, 1)]
    assert rows(incidents.similar_to(mem, "INC-3"), "incident_id") == [("INC-1",), ("INC-2",)]
    assert rows(incidents.similar_to(mem, "INC-9")) == []


def test_controls_need_a_verified_recovery(spark):
    df = spark.createDataFrame([(1, "SCHEMA_CONTRACT_VIOLATION", "PASSED"),
                                (2, "SCHEMA_CONTRACT_VIOLATION", "FAILED"), (3, "UNKNOWN", "PASSED")],
                               "incident_key int, classification string, post_execution_status string")
    got = incidents.controls(df, ["incident_key"]).collect()
    assert [(r.incident_key, r.control_id) for r in got] == [
        (1, f"PREV-00{i}") for i in (1, 2, 3, 4)]


def test_orphan_artifacts(spark, rows):
    named = spark.createDataFrame([("risk", 1), ("risk", 2), ("risk", 2), ("plan", None)],
                                  "artifact string, incident_key int")
    known = spark.createDataFrame([(1,)], "incident_key int")
    assert rows(incidents.orphan_artifacts(named, known), "artifact", "incident_key",
                "n_artifacts") == [("plan", None, 1), ("risk", 2, 2)]


# Files --------------------------------------------------------------------------

def test_incident_documents(spark, rows, tmp_path):
    for i in (2, 1):
        (tmp_path / f"INC-2026093{i}-001.json").write_text(json.dumps({
            "incident_id": f"INC-2026093{i}-001", "pipeline_name": "p", "severity": "P1",
            "status": "DETECTED", "error_type": "SCHEMA_DRIFT", "affected_assets": ["a"],
            "evidence": [{"type": "SCHEMA_CONTRACT", "expected_columns": ["a"],
                          "actual_columns": ["a", "b"], "unexpected_columns": ["b"]}],
            "root_cause": "why"}, indent=2))
    (tmp_path / "notes.txt").write_text("not an incident")
    docs = tables.read_incidents(spark, str(tmp_path))
    assert [r.incident_id for r in incidents.listing(docs).collect()] \
        == ["INC-20260931-001", "INC-20260932-001"]
    judged = incidents.investigate(incidents.root_cause(incidents.first_evidence(docs)))
    assert {r.investigation_status for r in judged.collect()} == {"COMPLETED"}
    assert incidents.evidence(docs).columns[-2:] == ["schema_contract_evidence", "root_cause"]


def test_events_are_scrubbed_split_and_appended(spark, tmp_path):
    when = dt.datetime(2024, 1, 1, 10, 0, 0, 123456)
    events = spark.createDataFrame(
        [("1", "INC-20260930-001", when, "ann", YES, "PASSED", {"token": "t", "a": "b"}),
         ("2", "INC-20260930-001", when, "ann", "made_up", "PASSED", None),
         ("3", "../../etc", when, "ann", YES, "PASSED", {}),
         ("4", None, when, "ann", None, "PASSED", {})], tables.EVENT_SCHEMA)
    valid, quarantined = audit.prepare(events)
    assert {r.event_id: r.invalid for r in quarantined.collect()} \
        == {"2": ["action"], "3": ["incident_id"], "4": ["incident_id", "action"]}
    folder = str(tmp_path / "log")
    sinks.append_events(valid, folder)
    sinks.append_events(valid.withColumn("event_id", F.lit("5")), folder)
    first = next((tmp_path / "log").glob("*/*.json"))
    first.write_text(first.read_text() + "\n\n")
    (first.parent / f".{first.name}.crc").unlink(missing_ok=True)
    got = audit.trail(tables.read_events(spark, folder)).collect()
    assert [r.event_id for r in got] == ["1", "5"]
    assert got[0].timestamp == when and got[0].details == {"a": "b"}


def test_publish_once(spark, tmp_path):
    source, registry = str(tmp_path / "rebuilt"), str(tmp_path / "registry")
    spark.range(3).write.parquet(source)
    schema = "incident_id string, strategy_id string, publish_allowed boolean, reason string"

    def publish(allowed, reason=None):
        rows = spark.createDataFrame([("I", "S", allowed, reason)], schema)
        return sinks.publish(spark, "I", "S", rows, {"gold": source}, str(tmp_path / "staged"), registry)

    assert publish(False, "Recovery is not authorized.") == "Recovery is not authorized."
    assert sinks.published(spark, registry).count() == 0
    assert publish(True) == "PUBLISHED"
    assert publish(True) == "ALREADY_PUBLISHED"
    target = sinks.published(spark, registry).collect()[0].target
    assert versions.read(spark, target, "gold").count() == 3
    other = spark.createDataFrame([], schema)
    assert sinks.publish(spark, "I", "T", other, {"gold": source}, str(tmp_path), registry) \
        == "No authorization record found."


def test_prevention_status(spark):
    df = spark.createDataFrame([(1, "SCHEMA_CONTRACT_VIOLATION", "PASSED"),
                                (2, "SCHEMA_CONTRACT_VIOLATION", None), (3, "UNKNOWN", "PASSED")],
                               "incident_key int, classification string, post_execution_status string")
    got = incidents.prevention_status(df, ["incident_key"]).collect()
    assert [(r.prevention_status, r.n_controls) for r in got] \
        == [("COMPLETED", 4), ("BLOCKED", 0), ("BLOCKED", 0)]
    assert [r.reason for r in got] == [None, "NOT_VERIFIED", "NO_CONTROLS"]


def test_investigation_finding(spark):
    df = spark.createDataFrame([("SCHEMA_DRIFT", ["a", "c"], ["a", "b"], ["b"], ["c"]), ("SCHEMA_DRIFT", None, None, [], []),
                                ("SCHEMA_DRIFT", ["a"], None, [], []), ("SCHEMA_DRIFT", ["a"], ["b"], [], []),
                                ("OTHER", ["a"], ["a"], [], [])], f"error_type string, {LISTS}")
    got = incidents.investigate(incidents.root_cause(df)).collect()
    assert [(r.finding, r.investigation_reason, r.investigation_confidence) for r in got] == [
        ("SCHEMA_CONTRACT_VIOLATION", None, "HIGH"), (None, "NO_EVIDENCE", "INSUFFICIENT_EVIDENCE"),
        (None, "INCOMPLETE_EVIDENCE", "INSUFFICIENT_EVIDENCE"), (None, "CONFLICTING_EVIDENCE", "INSUFFICIENT_EVIDENCE"),
        (None, None, "INSUFFICIENT_EVIDENCE")]
    assert got[0].reported_unexpected == ["b"] and got[0].reported_missing == ["c"]


def test_workflow_status(spark, rows):
    seen = spark.createDataFrame([(1, "COMPLETED"), (2, "COMPLETED"), (3, "BLOCKED"), (4, "COMPLETED"),
                                  (5, "COMPLETED")], "incident_key int, investigation_status string")
    chosen = spark.createDataFrame(
        [(1, 7, "COMPLETED"), (2, 7, "COMPLETED"), (3, 7, "COMPLETED"), (4, 7, "BLOCKED")],
        "incident_key int, recommended_strategy_key int, status string")
    tried = spark.createDataFrame([(1, 7, "PASSED"), (2, 7, "WARNING"), (3, 7, "PASSED"),
                                   (4, 7, "PASSED")],
                                  "incident_key int, strategy_key int, preview_status string")
    got = rows(incidents.workflow_status(seen, chosen, tried), "incident_key", "workflow_status",
               "next_step")
    blocked = ("BLOCKED", "UNBLOCK")
    assert got == [(1, "WAITING_FOR_HUMAN_APPROVAL", "APPROVE")] + [
        (i, *blocked) for i in (2, 3, 4, 5)]


def test_resolution(spark):
    def side(columns, *values):
        return spark.createDataFrame(list(values), f"incident_key int, {columns}")
    base = side("incident_id string", (1, "a"), (2, "b"), (3, "c"))
    when = dt.datetime(2024, 1, 1)
    got = incidents.resolution(
        base, side("strategy_key int", (1, 7)), side("executed_at timestamp", (1, when), (2, when)),
        side("post_execution_status string", (1, "PASSED"), (2, "PASSED")),
        side("data_verification_status string", (1, "PASSED"), (2, "FAILED"))).collect()
    assert {r.incident_key: r.resolution_status for r in got} == {1: "RESOLVED", 2: "OPEN", 3: "OPEN"}


def test_copy_of_a_missing_record_warns(spark, tmp_path):
    with pytest.warns(UserWarning, match="no record"):
        assert sinks.copy_record(spark, str(tmp_path / "none"), str(tmp_path / "out")) is False
    sinks.write_record(spark.range(1), str(tmp_path / "one"))
    assert sinks.copy_record(spark, str(tmp_path / "one"), str(tmp_path / "out")) is True
    assert spark.read.json(str(tmp_path / "out")).collect()[0].id == 0
