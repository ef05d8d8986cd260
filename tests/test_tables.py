"""Deduplication, scans, rules, silver and gold."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.operators import dedup, risk, rules, scan
from lakewarden.plans import medallion
from lakewarden.sources import tables

RAW = fixed.RAW_CUSTOMER_SCHEMA


def test_latest_by_key(spark, rows):
    data = [(1, "2024-01-01", "a"), (1, "2024-01-03", "b"), (1, None, "c"), (None, "2024-01-09", "d"),
            (2, None, "e"), (3, "2024-01-01", "y"), (3, "2024-01-01", "x")]
    df = spark.createDataFrame(data, "k int, t string, v string")
    out = dedup.latest_by_key(df, ["k"], ["t"])
    assert rows(out) == [(1, "2024-01-03", "b"), (2, None, "e"), (3, "2024-01-01", "x")]
    assert rows(dedup.latest_by_key(out, ["k"], ["t"])) == rows(out)
    assert rows(dedup.latest_by_key(df.limit(0), ["k"], ["t"])) == []


def test_one_per_key_keeps_the_null_key(spark, rows):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "z"), (None, "y")], "k int, v string")
    assert rows(dedup.one_per_key(df, ["k"])) == [(1, "a"), (None, "y")]
    assert rows(dedup.one_per_key(df, ["k"], [F.desc("v")])) == [(1, "b"), (None, "z")]


def test_hot_key_is_cut_down_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = dedup.latest_by_key(df, ["k"], ["t"])._jdf.queryExecution().toString()
    assert "row_number(), 1, Partial" in plan


@pytest.mark.parametrize("partitions", [1, 7, 100])
def test_running_max_does_not_depend_on_chunks(spark, rows, partitions):
    rng = random.Random(partitions)
    data = [(rng.choice([1, 2, None]), i, rng.choice([None, rng.randint(0, 50)]))
            for i in range(200)]
    df = spark.createDataFrame(data, "k int, i int, v int")
    got = rows(scan.running_max(df, ["k"], ["i"], F.col("v"), "m", partitions))
    seen, want = {}, []
    for k, i, v in data:
        want.append((k, i, v, seen.get(k)))
        if v is not None:
            seen[k] = max(v, seen.get(k, v))
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("partitions", [1, 7, 100])
def test_row_numbers(spark, rows, partitions):
    data = [(k, i) for k in (1, None) for i in range(50)]
    df = spark.createDataFrame(data, "k int, i int").repartition(5)
    got = rows(scan.row_numbers(df, ["k"], [F.asc("i")], "n", partitions))
    assert all(n == i + 1 for _, i, n in got) and len(got) == 100


def test_scan_shuffles_the_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"))
        out = scan.running_max(df, ["k"], ["i"], F.col("i"), "m")
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # chunk summaries, summaries by key, and rows with the carried values by chunk
        assert plan.count("Exchange hashpartitioning") == 3 and "Join" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chunks_of_a_hot_key_shrink_as_partitions_rise(spark):
    """A third of the rows share a key, and most of those a day."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 10 < 9, 5).otherwise(F.col("id") % 50).alias("day"), "id")
    largest = []
    for partitions in (4, 16, 64):
        parts = scan._chunked(df, ["k"], [F.col("day"), F.col("id")], F.lit(1), partitions)
        largest.append(parts.groupBy("_part").count().agg(F.max("count")).first()[0])
    assert largest[0] > 2 * largest[1] > 4 * largest[2]


def test_rank_of_text_ids(spark, rows):
    data = [(1, f"REC-{i:03d}", i % 4, 1) for i in range(40)]
    df = spark.createDataFrame(data, "incident_key int, strategy_key string, risk_score bigint, scope_size bigint")
    want = sorted(data, key=lambda r: (r[2], r[1]))
    got = risk.rank(df).orderBy("strategy_rank").collect()
    assert [(r.strategy_rank, r.strategy_key) for r in got] == [(i + 1, r[1]) for i, r in enumerate(want)]


def test_rules_run_in_order(spark, rows):
    first = rules.Rule("NEGATIVE", lambda: F.col("v") < 0, lambda: {"v": F.abs("v")})
    second = rules.Rule("LARGE", lambda: F.col("v") > 10)
    df = spark.createDataFrame([(1, -20), (2, 5), (3, None), (4, 20)], "id int, v int")
    out = rules.apply(df, [first, second], "flags")
    assert rows(out) == [(1, 20, "NEGATIVE|LARGE"), (2, 5, "CLEAN"), (3, None, "CLEAN"),
                         (4, 20, "LARGE")]


def raw(**values):
    names = [c.strip().split(" ")[0] for c in RAW.split(",")]
    base = {"customer_id": 1, "customer_name": " Ann ", "email": "a@b.co", "country": " us ",
            "customer_segment": "retail", "loyalty_tier": None, "status": "Active ",
            "marketing_opt_in": "true", "date_of_birth": "1990-01-01", "total_orders": "2",
            "total_revenue": "10.00", "avg_order_value": "5.00", "lifetime_value": "100.00",
            "churn_risk_score": "50", "currency": "USD", "postal_code": "01234",
            "registration_date": "2001-12-31", "last_purchase_date": None,
            "returns_count": "0", "support_tickets_count": "x",
            "last_updated_at": "2001-12-31 10:00:00"}
    return tuple({**base, **values}.get(n) for n in names)


def silver(spark, *records):
    return medallion.silver(spark.createDataFrame(list(records), RAW), "2002-01-01")


def test_silver_meets_the_contract(spark):
    out = silver(spark, raw())
    assert set(out.columns) == set(fixed.CUSTOMER_CONTRACT_COLUMNS)
    row = out.collect()[0]
    assert (row.customer_name, row.country, row.status, row.loyalty_tier) \
        == ("Ann", "US", "ACTIVE", "NONE")
    assert row.postal_code == "01234" and row.support_tickets_count is None
    assert (row.marketing_opt_in, row.date_of_birth) == (True, dt.date(1990, 1, 1))
    assert (row.customer_tenure_days, row.days_since_last_purchase) == (1, None)
    assert row.churn_risk_label == "MEDIUM" and row.data_quality_flags == "CLEAN"


def test_silver_flags_everything_at_once(spark):
    row = silver(spark, raw(email=None, total_revenue="-5", churn_risk_score="140",
                            avg_order_value="7", currency="INR", lifetime_value="166667")
                 ).collect()[0]
    assert row.data_quality_flags == "|".join([
        fixed.FLAG_INVALID_EMAIL, fixed.FLAG_NEGATIVE_REVENUE, fixed.FLAG_CHURN_RANGE,
        fixed.FLAG_AOV_MISMATCH])
    assert (row.total_revenue_local, row.avg_order_value_local, row.churn_risk_score) == (0, 0, 100)
    assert row.lifetime_value_usd == Decimal("2000.00400") and row.is_high_value_customer


def test_cast_failures(spark, rows):
    feed = spark.createDataFrame([raw(), raw(total_revenue="x", date_of_birth="1990-13-01")], RAW)
    failed = {c: n for c, n in rows(medallion.cast_failures(feed)) if n}
    assert failed == {"support_tickets_count": 2, "total_revenue": 1, "date_of_birth": 1}


def test_silver_boundaries(spark):
    exact = silver(spark, raw(lifetime_value="2000.00", total_orders="0", avg_order_value="9")
                   ).collect()[0]
    assert exact.is_high_value_customer is False
    assert exact.data_quality_flags == "CLEAN" and exact.avg_order_value_local == 0
    third = silver(spark, raw(total_orders="3", avg_order_value="3.33", currency="EUR")).collect()[0]
    assert third.avg_order_value_local == Decimal("3.333333")
    assert third.avg_order_value_usd == Decimal("3.599999640")


def test_scorecard(spark):
    records = [raw(), raw(last_updated_at="2001-01-01"), raw(customer_id=None),
               raw(customer_id=2, email="x"), raw(customer_id=3, total_revenue="-1")]
    feed = spark.createDataFrame(records, RAW)
    card = medallion.scorecard(feed, medallion.silver(feed, "2002-01-01")).collect()[0]
    assert card.raw_record_count == 5 and card.deduplicated_record_count == 3
    assert card.duplicates_removed == 2 and card.null_key_removed == 1
    assert card.invalid_email_count == 1 and card.revenue_anomaly_count == 1
    assert card.clean_record_count == 1 and card.clean_record_pct == Decimal("33.33")


def test_scorecard_of_nothing(spark):
    feed = spark.createDataFrame([], RAW)
    card = medallion.scorecard(feed, medallion.silver(feed, "2002-01-01")).collect()[0]
    assert card.raw_record_count == 0 and card.clean_record_pct == 0


def test_gold(spark, rows):
    out = medallion.gold(silver(
        spark, raw(customer_id=1, total_revenue="0.005"), raw(customer_id=2, status="churned"),
        raw(customer_id=3, country=None, customer_segment="Online", loyalty_tier="gold")))
    assert rows(out["customer_summary"], "country", "total_customers", "churned_customers") \
        == [("US", 2, 1), (None, 1, 0)]
    assert rows(out["segment_performance"], "customer_segment", "churn_rate_pct") \
        == [("ONLINE", Decimal("0.00")), ("RETAIL", Decimal("50.00"))]
    assert rows(out["loyalty_tier_distribution"], "loyalty_tier", "pct_of_customer_base") \
        == [("GOLD", Decimal("33.33")), ("NONE", Decimal("66.67"))]
    assert rows(out["churn_risk_summary"], "churn_risk_label", "avg_days_since_last_purchase") \
        == [("MEDIUM", None)]
    assert rows(out["acquisition_channel_performance"], "countries_reached") == [(1,)]


def test_flow_from_a_csv_file(spark, tmp_path):
    names = [c.strip().split(" ")[0] for c in RAW.split(",")]
    spark.createDataFrame([raw(), raw(customer_id=2, customer_name='Q "x", y')], RAW).select(
        *names).coalesce(1).write.option("header", True).csv(str(tmp_path / "in"))
    feed = tables.read_csv(spark, str(tmp_path / "in"))
    paths = medallion.run(spark, feed.drop("_corrupt_record"), str(tmp_path / "out"), "b1",
                          "2002-01-01 00:00:00", "2002-01-01", "customers.csv")
    stored = spark.read.parquet(paths["bronze"])
    assert stored.columns[-3:] == fixed.INGEST_COLUMNS
    assert {r.source_file_name for r in stored.collect()} == {"customers.csv"}
    assert {r.customer_name for r in spark.read.parquet(paths["silver"]).collect()} \
        == {"Ann", 'Q "x", y'}
    assert spark.read.parquet(paths["customer_summary"]).collect()[0].total_customers == 2
    assert spark.read.json(paths["scorecard"]).collect()[0].clean_record_count == 2
    by_file = medallion.bronze(feed, "b2", "2002-01-01 00:00:00")
    assert by_file.select("source_file_name").distinct().collect()[0][0].endswith(".csv")


def test_corrupt_csv_rows_are_kept(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,x\nnot a number,y\n2\n")
    got = tables.read_csv(spark, str(path), "a int, b string").cache().collect()
    assert [(r.a, r._corrupt_record is not None) for r in got] == [(1, False), (None, True), (2, True)]
