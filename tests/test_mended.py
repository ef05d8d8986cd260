"""Cases that used to fail: schema drift, text ids, unsafe ids, approvals before verification."""

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import approvals, reconcile, risk
from lakewarden.sources import sinks


def test_report_survives_another_type(spark):
    before = spark.createDataFrame([(1, 5)], "k int, v int")
    after = spark.createDataFrame([(1, "x10")], "k int, v string")
    got = reconcile.report(spark, before, after).first()
    assert not got["schema_match"] and got["status"] == "FAILED" and got["added_records"] == 1


def test_added_and_dropped_columns_are_reported(spark, rows):
    before = spark.createDataFrame([(1, 5, "a")], "k int, v int, gone string")
    after = spark.createDataFrame([(1, 6, 2.0)], "k int, v int, extra double")
    assert rows(reconcile.schema_changes(spark, before, after), "column", "change") == [
        ("extra", "added"), ("gone", "removed")]
    assert rows(reconcile.keyed_diff(before, after, ["k"]), "k", "change") == [(1, "changed")]
    assert reconcile.set_diff(before, after).count() == reconcile.bag_diff(before, after).count() == 2
    assert reconcile.schema_changes(spark, before, before).count() == 0


def test_rank_takes_text_ids(spark):
    scored = spark.createDataFrame([("I", f"REC-{n:03d}", 5 - n % 2, 1) for n in range(1, 8)],
                                   "incident_key string, strategy_key string, risk_score int, scope_size int")
    got = {r["strategy_key"]: r["strategy_rank"] for r in risk.rank(scored).collect()}
    order = sorted(got, key=lambda s: (5 - int(s[-3:]) % 2, s))
    assert [got[s] for s in order] == list(range(1, 8))


@pytest.mark.parametrize("incident, strategy", [("../x", "REC-1"), ("INC-1", "a/b"), ("", "REC-1"), ("INC-1", "..")])
def test_publish_refuses_what_is_no_id(spark, incident, strategy):
    with pytest.raises(ValueError, match="not an id"):
        sinks.publish(spark, incident, strategy, None, {}, "/nowhere", "/nowhere")


@pytest.mark.parametrize("asked, granted, state, refused", [
    (None, "PASSED", "PENDING", 1), ("BLOCKED", "PASSED", "PENDING", 1), ("PASSED", "BLOCKED", "PENDING", 1),
    ("PASSED", "PASSED", "APPROVED", 0)])
def test_approval_counts_as_of_its_request(spark, asked, granted, state, refused):
    events = spark.createDataFrame(
        [(1, 7, 0, "approval_requested", asked, "a"), (2, 7, 3600, "approval_granted", granted, "b")],
        "event_id int, incident_key int, s int, action string, status string, actor string").withColumn(
        "ts", F.timestamp_seconds("s"))
    verified = spark.createDataFrame([(7, True)], "incident_key int, verification_passed boolean")
    got = approvals.approval_state(events, verified).first()
    assert (got["approval_status"], got["blocked_attempts"]) == (state, refused)
    assert got["execution_allowed"] == (state == "APPROVED")
