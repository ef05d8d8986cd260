"""Contracts, reconciliation, checks and rebuild."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.operators import checks, contract, reconcile, recovery
from lakewarden.sources import tables


def judge(spark, columns, agreed, allow_new=False):
    df = spark.createDataFrame([], ", ".join(columns))
    rule = contract.declare(spark, {"t": (agreed, allow_new)})
    changes = contract.diff(contract.schema_rows(spark, {"t": df}), rule)
    return contract.verdict(changes, rule).collect()[0]


@pytest.mark.parametrize("columns,agreed,allow,verdict,unexpected,missing", [
    (["a int", "b int"], ["b", "a"], False, fixed.VERDICT_PASSED, [], []),
    (["a int", "b int", "c int"], ["a", "b"], False, fixed.VERDICT_DRIFT, ["c"], []),
    (["a int", "c int"], ["a", "b"], False, fixed.VERDICT_DRIFT, ["c"], ["b"]),
    (["a int", "c int"], ["a", "b"], True, fixed.VERDICT_MISSING, ["c"], ["b"]),
    (["a int"], ["a", "b"], False, fixed.VERDICT_MISSING, [], ["b"]),
    (["a int", "c int"], ["a"], True, fixed.VERDICT_PASSED, ["c"], []),
    (["A int"], ["a"], False, fixed.VERDICT_DRIFT, ["A"], ["a"]),
])
def test_verdict(spark, columns, agreed, allow, verdict, unexpected, missing):
    got = judge(spark, columns, agreed, allow)
    assert (got.verdict, got.unexpected_columns, got.missing_columns) == (verdict, unexpected, missing)


def test_type_drift_and_inference(spark, rows):
    got = judge(spark, ["a int", "b string"], [("a", "bigint"), ("b", "string")])
    assert got.type_changed_columns == ["a"] and got.verdict == fixed.VERDICT_PASSED
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    inferred = contract.infer(spark, {"t": df})
    required = contract.require_values(inferred, contract.filled({"t": df}))
    assert rows(required, "column", "type", "nullable") == [("a", "int", False), ("b", "string", True)]


def test_contract_document(spark, rows, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({
        "pipeline": "p", "source": "t", "expected_columns": ["x", "y"], "allow_new_columns": True},
        indent=2))
    got = tables.read_contract(spark, str(tmp_path / "c.json"))
    assert rows(got) == [("t", True, 0, "x"), ("t", True, 1, "y")]


def test_projection_fails_closed(spark):
    df = spark.createDataFrame([(1, 2)], "b int, a int")
    assert contract.project(df, ["a", "b"]).columns == ["a", "b"]
    with pytest.raises(ValueError, match="c"):
        contract.project(df, ["a", "c"])


@pytest.mark.parametrize("expected,actual,unexpected,missing,state", [
    (["a"], ["a", "b"], ["b"], [], "consistent"), (["a"], ["a", "b"], ["b"], None, "consistent"),
    (["a", "c"], ["a"], [], None, "conflicting"), (["a"], ["a", "b", "c"], ["c", "b"], [], "consistent"),
    (["a"], ["a"], ["b"], [], "conflicting"), (None, ["a"], [], [], "malformed"),
    (["a"], None, [], [], "malformed"), ([], [], [], [], "consistent")])
def test_evidence(spark, expected, actual, unexpected, missing, state):
    schema = ", ".join(f"{n}_columns array<string>" for n in
                       ("expected", "actual", "unexpected", "missing"))
    df = spark.createDataFrame([(expected, actual, unexpected, missing)], schema)
    assert contract.audit_evidence(df).collect()[0].evidence_state == state


# Reconciliation ---------------------------------------------------------------

def table(spark, data, schema="k int, v string"):
    return spark.createDataFrame(data, schema)


def test_diff_of_equal_tables(spark, rows):
    a = table(spark, [(1, "x"), (None, None), (None, None)])
    for diff in (reconcile.set_diff, reconcile.bag_diff):
        assert rows(diff(a, a.select("k", "v"))) == []
    assert reconcile.report(spark, a, a).collect()[0].status == "PASSED"


def test_repeated_row_is_seen_by_the_bag_only(spark, rows):
    a, b = table(spark, [(1, "x")]), table(spark, [(1, "x"), (1, "x")])
    assert rows(reconcile.set_diff(a, b)) == []
    assert rows(reconcile.bag_diff(a, b)) == [(1, "x", "added", 1)]
    by_set = reconcile.report(spark, a, b, "set").collect()[0]
    assert by_set.values_match and not by_set.row_count_match and by_set.status == "FAILED"
    assert reconcile.report(spark, a, b, "bag").collect()[0].added_records == 1


def test_report_cases(spark):
    a, empty = table(spark, [(1, "x"), (2, None)]), table(spark, [])
    swapped = reconcile.report(spark, a, a.select("v", "k")).collect()[0]
    assert not swapped.schema_match and swapped.values_match and swapped.status == "FAILED"
    assert reconcile.report(spark, empty, empty).collect()[0].status == "PASSED"
    gone = reconcile.report(spark, a, empty).collect()[0]
    assert (gone.removed_records, gone.added_records, gone.before_rows) == (2, 0, 2)
    lower, upper = table(spark, [(1, "us")]), table(spark, [(1, "US")])
    assert reconcile.report(spark, lower, upper).collect()[0].status == "FAILED"
    assert reconcile.report(spark, lower, upper, "set", ["v"]).collect()[0].status == "PASSED"


def test_canonical_types(spark):
    out = reconcile.canonical(table(spark, [(1, "7")]), {"v": "bigint", "k": "string"})
    assert out.dtypes == [("v", "bigint"), ("k", "string")]


def test_keyed_diff(spark, rows):
    schema = "k int, v string, w int"
    a = table(spark, [(1, "x", 1), (2, "y", 2), (3, "z", 3), (4, "q", 4), (None, "n", 0), (6, "s", 6)],
              schema)
    b = table(spark, [(1, "x", 1), (2, "Y", 2), (4, "q", 4), (4, "q", 4), (5, "new", 5),
                      (None, "n", None), (6, "t", 7)], schema)
    assert rows(reconcile.keyed_diff(a, b, ["k"])) == [
        (2, 1, 1, "changed", ["v"]), (3, 1, 0, "removed", []), (4, 1, 2, "repeated", []),
        (5, 0, 1, "added", []), (6, 1, 1, "changed", ["v", "w"]), (None, 1, 1, "changed", ["w"])]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["a", None])), max_size=8),
       st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["a", None])), max_size=8))
def test_bag_diff_equals_counting(spark, before, after):
    got = {(r.k, r.v): r.copies * (1 if r.change == "added" else -1) for r in
           reconcile.bag_diff(table(spark, before), table(spark, after)).collect()}
    want = {x: after.count(x) - before.count(x) for x in {*before, *after}}
    assert got == {k: n for k, n in want.items() if n}


# Checks -----------------------------------------------------------------------

def status(df):
    return [(r.check, r.status, r.observed, r.expected) for r in df.collect()]


def test_checks(spark, rows):
    df = table(spark, [(1, "x"), (1, None), (2, "y"), (None, "z")])
    assert rows(checks.duplicate_summary(df, ["k"])) == [(1, 1)]
    assert rows(checks.null_counts(df, ["k", "v"])) == [("k", 1), ("v", 1)]
    assert rows(checks.unaccepted_values(df, {"v": ["x", "y"]})) == [("v", "z", 1), ("v", None, 1)]
    assert status(checks.check_nulls(df, ["k", "v"])) == [("null_check", "FAILED", "2", "0")]
    assert status(checks.check_duplicates(df, ["k"])) == [("duplicate_check", "FAILED", "1", "0")]
    assert status(checks.check_row_count(df, df.limit(3))) == [("row_count", "FAILED", "4", "3")]
    assert status(checks.check_row_count(df, df.limit(3), 1))[0][1] == "PASSED"
    parent = table(spark, [(1, ""), (1, "")])
    assert rows(checks.orphans(df, "k", parent, "k")) == [(2, 1)]
    assert status(checks.check_references(df, "k", parent, "k"))[0][1:3] == ("FAILED", "1")
    assert status(checks.check_rederived(df, df))[0][1] == "PASSED"


def test_checks_on_nothing(spark, rows):
    empty = table(spark, [])
    assert rows(checks.duplicate_summary(empty, ["k"])) == [(0, 0)]
    assert status(checks.check_references(empty, "k", empty, "k"))[0][1] == "PASSED"
    dates = spark.createDataFrame([], "t timestamp")
    assert status(checks.check_freshness(dates, "t", "2024-01-02", "1 day"))[0][1] == "FAILED"


def test_freshness_bound_is_inclusive(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string").select(
        F.col("t").cast("timestamp").alias("t"))
    assert status(checks.check_freshness(df, "t", "2024-01-02", "1 day"))[0][1] == "PASSED"
    assert status(checks.check_freshness(df, "t", "2024-01-03", "1 day"))[0][1] == "FAILED"


def test_overall(spark):
    df = table(spark, [(1, "x")])
    good, bad = checks.check_nulls(df, ["k"]), checks.check_row_count(df, df.limit(0))
    assert checks.overall(checks.run([good, bad])).collect()[0][:] == (2, 1, "FAILED")
    assert checks.overall(checks.run([good])).collect()[0][:] == (1, 0, "PASSED")
    assert checks.overall(good.limit(0)).collect()[0][:] == (0, 0, "FAILED")


def test_late_rows(spark, rows):
    data = [("u", 1, 10), ("u", 2, 30), ("u", 3, 20), ("u", 4, None), ("u", 5, 29), ("w", 1, 5)]
    df = spark.createDataFrame(data, "k string, i int, s int").withColumn(
        "t", F.timestamp_seconds("s"))
    out = checks.late_rows(df, ["k"], ["i"], "t", "5 seconds")
    assert rows(out.filter("late"), "k", "i") == [("u", 3)]


def test_combined_failures(spark, rows):
    df = table(spark, [(1, "x"), (None, None), (None, "x"), (None, None)])
    out = checks.combined_failures(df, [("no_k", F.col("k").isNull()), ("no_v", F.col("v").isNull())])
    assert rows(out) == [("no_k", 1, 1), ("no_k|no_v", 2, 2)]


# Rebuild ----------------------------------------------------------------------

def test_rebuild(spark, rows):
    df = spark.createDataFrame(
        [(1, " us ", "ACTIVE", "seg", 2), (1, "US", "INACTIVE", None, 1), (2, None, "ACTIVE", "s", 1),
         (None, "US", "INACTIVE", "s", 1)],
        "customer_id int, country string, status string, extra string, version int")
    expected = ["status", "customer_id", "country"]
    out = recovery.rebuild(df, expected, ["customer_id"], ["country"], [F.desc("version")])
    assert out.columns == expected
    assert rows(out, "customer_id", "country") == [(1, " us "), (2, None), (None, "US")]
    assert rows(recovery.summary_by_country(out)) == [(" us ", 1, 1, 0), ("US", 1, 0, 1), (None, 1, 1, 0)]
    assert rows(recovery.summary_by_country_joined(out)) == [
        (" us ", 1, 1, 0), ("US", 1, 0, 1), (None, 1, None, None)]
    assert rows(recovery.preview(df, expected, ["customer_id"])) == [
        ("column", "extra", 3), ("column", "version", 4), ("rows", "customer_id", 1)]
    blocked = recovery.preview(df, [*expected, "email"], ["customer_id"])
    assert ("missing", "email", None) in rows(blocked)
    with pytest.raises(ValueError, match="email"):
        recovery.rebuild(df, [*expected, "email"], ["customer_id"])


def test_range_diff_is_the_bag_difference(spark, rows):
    base = [(k, f"v{k % 7}", None if k % 5 else k) for k in range(-300, 3000, 3)] + [(9, "v2", None)] * 3 + [(None, "n", 1)]
    schema = "k long, x string, y int"
    before = spark.createDataFrame(base, schema)
    for change in (lambda r: [r], lambda r: [] if r[0] == 900 else [r], lambda r: [r, r] if r[0] == -300 else [r],
                   lambda r: [(r[0], "z", r[2])] if r[0] in (None, 2997) else [r],
                   lambda r: [(r[0], r[2] and str(r[2]), None)] if r[0] and 0 < r[0] < 40 else [r],
                   lambda r: [] if r[0] and r[0] % 2 else [r], lambda r: []):
        after = spark.createDataFrame([x for r in base for x in change(r)], schema)
        for fanout, depth in ((4, 3), (64, 2)):
            got = reconcile.range_diff(before, after, "k", fanout, depth)
            assert rows(got) == rows(reconcile.bag_diff(before, after))
    none = before.limit(0)
    assert reconcile.range_diff(none, none, "k").count() == 0


def test_equal_ranges_are_not_shuffled(spark, tmp_path):
    spark.range(100_000).selectExpr("id as k", "id * 3 as v").write.parquet(str(tmp_path / "t"))
    before = spark.read.parquet(str(tmp_path / "t"))
    after = before.withColumn("v", F.when(F.col("k").isin(7, 5_000, 99_999), -1).otherwise(F.col("v")))
    ranges = reconcile.differing_ranges(before, after, "k")
    assert len(ranges) == 3 and sum(b - a + 1 for a, b in ranges) <= 3 * 25
    left = reconcile.within(before, "k", ranges)
    assert left.count() <= 75
    assert "PushedFilters: [IsNotNull(k), GreaterThanOrEqual(k," in left._jdf.queryExecution().executedPlan().toString()
    # Swapped values keep every column's sum, but not the rows'.
    swapped = before.withColumn("v", F.when(F.col("k") == 1, 6).when(F.col("k") == 2, 3).otherwise(F.col("v")))
    assert len(reconcile.differing_ranges(before, swapped, "k")) == 1


def test_all_checks_in_one_pass(spark, rows):
    schema = "k long, g int, x string, t timestamp, v long"
    day = dt.datetime(2024, 1, 1)
    base = [(1, 1, "a", day, 5), (2, 1, "b", day, 7), (3, 2, "c", None, 9), (None, None, "d", day, None), (4, 3, "e", day, 1)]
    cases = [base, base[:0], base + base[:2], [(k, g, None, t, v) for k, g, _, t, v in base], base[1:],
             [(k, None, x, t, v) for k, _, x, t, v in base], base + [(9, 9, "n", None, None)], [base[3]] * 3]
    child = spark.createDataFrame([(1,), (1,), (3,), (8,), (8,), (None,)], "p long")

    def totals(df):
        return df.groupBy("g").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n"))

    before = spark.createDataFrame(base, schema)
    for case in cases:
        df = spark.createDataFrame(case, schema)
        got = checks.check_all(df, before, "k", ["k", "x"], "t", "2024-01-02", "2 days", child, "p", "g", "v", 1)
        single = checks.run([
            checks.check_table(df, before, ["k", "x"], "t", "2024-01-02", "2 days", 1), checks.check_duplicates(df, ["k"]),
            checks.check_references(child, "p", df, "k"), checks.check_rederived(totals(before), totals(df))])
        assert rows(got) == rows(single)
