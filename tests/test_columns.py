from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import collections as C
from lakewarden.functions import columns as X
from lakewarden.functions import exact


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).collect()[0]["x"]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("value,good", [
    ("a@b.co", True), ("a.b+c%d_e-f@x-y.example.org", True), ("a@b.c", False), ("a@b", False),
    ("ab.co", False), ("", False), (None, False), ("a@b.co\n", False), (" a@b.co", False),
])
def test_email(spark, value, good):
    assert one(spark, X.is_email(text(value))) is good


@pytest.mark.parametrize("value,good", [
    ("INC-20260930-001", True), ("../../etc/passwd", False), ("INC-2026-001", False),
    ("inc-20260930-001", False), ("INC-20260930-0011", False), ("", False), (None, False),
    ("INC-20260930-001\n", False),
])
def test_incident_id(spark, value, good):
    assert one(spark, X.matches(text(value), fixed.INCIDENT_ID_PATTERN)) is good


@pytest.mark.parametrize("value,good", [
    ("A. Person-1_x", True), ("x" * 64, True), ("x" * 65, False), ("a;b", False), ("", False)])
def test_actor(spark, value, good):
    assert one(spark, X.matches(text(value), fixed.ACTOR_NAME_PATTERN)) is good


def test_accepted_values(spark):
    assert one(spark, X.accepted(X.standardize(text(" active ")), fixed.CUSTOMER_STATES)) == "ACTIVE"
    assert one(spark, X.accepted(text("bogus"), fixed.CUSTOMER_STATES)) == "UNKNOWN"
    assert one(spark, X.accepted(text(None), fixed.CUSTOMER_STATES)) == "UNKNOWN"
    assert one(spark, X.or_label(X.standardize(text(None)), "NONE")) == "NONE"


def test_casts(spark):
    assert one(spark, X.typed(text("12x"), "int")) is None
    assert one(spark, X.cast_failed(text("12x"), "int")) is True
    assert one(spark, X.cast_failed(text("12"), "int")) is False
    assert one(spark, X.cast_failed(text(None), "int")) is False
    assert one(spark, X.typed(text("2024-02-30"), "date")) is None


@pytest.mark.parametrize("kind", ["int", "bigint", "decimal(18,2)", "boolean", "date", "double"])
def test_text_casts_equal_plain_casts(spark, kind):
    values = ["1", " 7 ", "-3", "+4", "1.5", ".5", "5.", "1e2", "1E-1", "", " ", "x", "1x", "0x1F",
              "1,000", "true", " T ", "NO", "yes", "0", "maybe", "NaN", "Infinity", "2024-01-02",
              "99999999999", "\t3\n", "--1", "e", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", X.typed(F.col("v"), kind).alias("a"), X.typed_text(F.col("v"), kind)
                    .alias("b"), X.cast_failed(F.col("v"), kind).alias("c"),
                    X.text_cast_failed(F.col("v"), kind).alias("d")).collect()
    for r in got:
        assert str(r.a) == str(r.b) and r.c == r.d, r


@pytest.mark.parametrize("value,clamped,broken", [
    (-1, 0, True), (0, 0, False), (100, 100, False), (101, 100, True), (None, None, None)])
def test_clamp(spark, value, clamped, broken):
    v = F.lit(value).cast("int")
    assert one(spark, X.within(v, 0, 100)) == clamped
    assert one(spark, X.outside(v, 0, 100)) is broken


@pytest.mark.parametrize("orders,revenue,stated,mismatch", [
    (0, "10", "5", False), (2, "10", "5.4", False), (2, "10", "5.5", False),
    (2, "10", "5.51", True), (2, "10", "4.5", False), (2, "10", "4.49", True),
    (2, "0", "1", True), (2, "0", "0", False), (None, "1", "1", None), (2, "10", None, None)])
def test_order_value_mismatch(spark, orders, revenue, stated, mismatch):
    def money(v):
        return F.lit(v).cast("decimal(18,2)")
    got = one(spark, X.ratio_mismatch(money(stated), money(revenue), F.lit(orders).cast("int"), 1))
    assert got is mismatch


@pytest.mark.parametrize("score,label", [
    (100, "HIGH"), (67, "HIGH"), (66, "MEDIUM"), (34, "MEDIUM"), (33, "LOW"), (None, "LOW")])
def test_churn_label(spark, score, label):
    assert one(spark, X.churn_label(F.lit(score).cast("int"))) == label


def test_fx_and_points(spark):
    got = {c: one(spark, X.fx_thousandths(text(c))) for c in ("USD", "EUR", "GBP", "INR", "JPY", None)}
    assert got == {"USD": 1000, "EUR": 1080, "GBP": 1270, "INR": 12, "JPY": 1000, None: 1000}
    assert [one(spark, X.level_points(text(v))) for v in ("HIGH", "MEDIUM", "LOW", "?", None)] \
        == [3, 2, 1, 2, 2]


def test_days(spark):
    day = F.lit("2001-12-30").cast("date")
    assert one(spark, X.days_until("2002-01-01", day)) == 2
    assert one(spark, X.days_until("2002-01-01", F.lit(None).cast("date"))) is None


def test_flags(spark):
    conditions = [("A", F.lit(True)), ("B", F.lit(None).cast("boolean")), ("C", F.lit(True))]
    assert one(spark, C.joined_flags(C.flag_list(conditions))) == "A|C"
    assert one(spark, C.joined_flags(C.flag_list([("A", F.lit(False))]))) == "CLEAN"


def test_lists(spark):
    assert one(spark, C.column_list(text("a,b"))) == ["a", "b"]
    assert one(spark, C.column_list(text(""))) == []
    assert one(spark, C.column_list(text(None))) is None
    assert one(spark, C.length(F.lit(None).cast("array<string>"))) == 0
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("x"), F.lit("x"))
    assert one(spark, C.same_members(a, b)) is True


def test_scrub(spark):
    details = F.create_map(*[F.lit(x) for x in (
        "Password", "1", "my_TOKEN_2", "2", "ApiKey", "3", "note", "4", "credentials", "5")])
    assert one(spark, C.scrub(details)) == {"note": "4"}


def test_fingerprint_keeps_null_apart(spark):
    a = one(spark, C.fingerprint(text(None).alias("x"), F.lit("1").alias("y")))
    b = one(spark, C.fingerprint(F.lit("1").alias("x"), text(None).alias("y")))
    assert a != b and len(a) == 64


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=30))
def test_rounded_mean_is_exact(spark, units):
    values = [Decimal(u).scaleb(-5) for u in units]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(24,5)")
    got = df.agg(exact.rounded_mean(F.col("v"), 5, 2).alias("m"),
                 exact.rounded_sum(F.col("v"), 5, 2).alias("s")).collect()[0]
    total = sum(units)
    mean = (Decimal(abs(total)) / (len(units) * 1000)).quantize(Decimal(1), ROUND_HALF_UP)
    # The quotient above is itself rounded at 28 digits; compare as integers as well.
    assert (2 * abs(total) + len(units) * 1000) // (2 * len(units) * 1000) == int(mean)
    sign = -1 if total < 0 else 1
    assert got["m"] == sign * mean.scaleb(-2)
    assert got["s"] == (Decimal(total).scaleb(-5)).quantize(Decimal("0.01"), ROUND_HALF_UP)


def test_rounded_mean_without_rows(spark):
    df = spark.createDataFrame([], "v decimal(24,5)")
    assert df.agg(exact.rounded_mean(F.col("v"), 5, 2)).collect()[0][0] is None
    assert df.agg(exact.percentage(F.count("v"), F.count(F.lit(1)))).collect()[0][0] is None
