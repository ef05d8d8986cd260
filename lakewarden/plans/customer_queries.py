"""Queries over the customer tables: bronze, silver, gold, rebuild."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import columns as X
from lakewarden.operators import approvals, dedup, recovery, rules
from lakewarden.plans import inputs, medallion
from lakewarden.plans.oracle_inputs import over
from lakewarden.plans.shape import plain
from lakewarden.session import stored, work_folder
from lakewarden.sources import sinks, tables, versions

REBUILD_COLUMNS = ["customer_id", "customer_name", "country", "status"]


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.marked_silver(inputs.customer_feed(spark, sf_dir), inputs.AS_OF)


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return medallion.silver(inputs.customer_feed(spark, sf_dir), inputs.AS_OF)


def _rule(flag: str) -> str:
    return f"_broken_{flag}"


# Ingestion --------------------------------------------------------------------

def bronze_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = inputs.raw_customers(spark, sf_dir)
    return plain(medallion.bronze(raw, inputs.BATCH_ID, inputs.INGESTED_AT, "customers"))


def csv_roundtrip_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and read back with declared types only."""
    folder = work_folder(spark, "csv")
    inputs.table(spark, sf_dir, "customer").write.option("header", True).csv(folder)
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    rows = tables.read_csv(spark, folder, ", ".join(f"{n} string" for n in names))
    types = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}
    failed = [X.text_cast_failed(F.col(n), t) for n, t in types.items()]
    return rows.select(
        *[X.typed_text(F.col(n), types[n]).alias(n) if n in types else F.col(n) for n in names],
        (failed[0] | failed[1] | failed[2]).alias("cast_failed"),
        F.col("_corrupt_record").isNotNull().alias("corrupt"))


def cast_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities read as numbers and dates: what does not fit."""
    orders = inputs.table(spark, sf_dir, "orders")
    text = F.col("o_orderpriority")
    return orders.select(
        text.alias("value"),
        X.typed_text(F.substring(text, 1, 1), "int").alias("as_int"),
        X.text_cast_failed(text, "int").alias("int_failed"),
        X.text_cast_failed(F.col("o_orderdate").cast("string"), "date").alias("date_failed"),
    ).groupBy("value", "as_int", "int_failed", "date_failed").agg(
        F.count(F.lit(1)).alias("n"))


# Deduplication ----------------------------------------------------------------

def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(dedup.latest_by_key(inputs.raw_customers(spark, sf_dir), ["customer_id"],
                                     ["last_updated_at"]))


def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events")
    return plain(dedup.latest_by_key(events, ["user_id"], ["ts"], [F.desc("event_id")]))


# Silver -----------------------------------------------------------------------

def silver_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = medallion.standardize(medallion.deduplicate(inputs.customer_feed(spark, sf_dir)))
    return rows.select("customer_id", "customer_name", "country", "customer_segment",
                       "loyalty_tier", "status")


def silver_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("customer_id", "email", "is_valid_email")


def silver_clamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_marked(spark, sf_dir).select(
        "customer_id", F.col("total_revenue_local").alias("total_revenue"), "churn_risk_score",
        F.col(_rule(fixed.FLAG_NEGATIVE_REVENUE)).alias("is_revenue_anomaly"),
        F.col(_rule(fixed.FLAG_CHURN_RANGE)).alias("is_churn_anomaly")))


def silver_aov_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_marked(spark, sf_dir).select(
        "customer_id", "total_orders", "avg_order_value_local",
        F.col(_rule(fixed.FLAG_AOV_MISMATCH)).alias("is_aov_mismatch")))


def silver_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_marked(spark, sf_dir).select(
        "customer_id", "currency", "total_revenue_usd", "avg_order_value_usd",
        "lifetime_value_usd", "is_high_value_customer"))


def _rates(spark: SparkSession) -> DataFrame:
    """Exchange rates as a stored table; one currency that customers use has none."""
    rows = [(c, n) for c, n in fixed.FX_THOUSANDTHS.items() if c != "GBP"] + [("JPY", 7)]
    return stored(spark.createDataFrame(rows, "currency string, thousandths int"), "rates")


def silver_fx_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollars by rates from a table; currencies without a rate are marked."""
    rows = medallion.silver(inputs.customer_feed(spark, sf_dir), inputs.AS_OF,
                            [*medallion.customer_rules(), medallion.CURRENCY_RULE], _rates(spark))
    return plain(rows.select("customer_id", "currency", "total_revenue_usd", "lifetime_value_usd",
                             "is_high_value_customer", "data_quality_flags"))


def _text_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer feed as a CSV would bring it, with some values that do not fit their type."""
    feed, k = inputs.customer_feed(spark, sf_dir), F.col("customer_id")
    texts = feed.withColumns({n: F.col(n).cast("string") for n in medallion.SILVER_TYPES if n in feed.columns})
    return texts.withColumns({
        "total_orders": F.when(k % 23 == 0, "many").otherwise(F.col("total_orders")),
        "registration_date": F.when(k % 29 == 0, "soon").otherwise(F.col("registration_date")),
        "lifetime_value": F.when(k % 31 == 0, "12345678901234567890").otherwise(F.col("lifetime_value"))})


def _cast_rules() -> list[rules.Rule]:
    return [medallion.CAST_RULE, *medallion.customer_rules()]


def silver_cast_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that does not fit its column is NULL and marked, too large numbers included."""
    rows = medallion.silver(_text_feed(spark, sf_dir), inputs.AS_OF, _cast_rules())
    return plain(rows.select("customer_id", "total_orders", "registration_date",
                             F.col("lifetime_value_local").alias("lifetime_value"), "data_quality_flags"))


def dq_scorecard_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard with failed casts counted."""
    feed = _text_feed(spark, sf_dir)
    score = medallion.scorecard(feed, medallion.silver(feed, inputs.AS_OF, _cast_rules()),
                                {fixed.FLAG_CAST_FAILED: "cast_failed_count"})
    return plain(score.select("raw_record_count", "deduplicated_record_count", "invalid_email_count",
                              "churn_anomaly_count", "cast_failed_count"))


def publish_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver and the gold tables published together; a second run ends between two tables, a third goes through.

    Returns what a reader finds after each.
    """
    root, silver = work_folder(spark, "versions"), stored(_silver(spark, sf_dir), "silver")
    clean = silver.filter(F.col("data_quality_flags") == fixed.CLEAN_LABEL)
    # Columns that do not exist in its second table end this run.
    runs = [{"silver": silver, **medallion.gold(silver)}, {"silver": clean, "broken": None},
            {"silver": clean, **medallion.gold(clean)}]
    found = []
    for number, published in enumerate(runs, 1):
        try:
            versions.publish(spark, root, published)
        except AttributeError:
            pass
        version, paths = versions.latest(spark, root)
        found += [spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(number).alias("run"), F.lit(version).alias("version"), F.lit(name).alias("name"), "n_rows")
            for name, path in paths.items() if name in ("silver", "customer_summary")]
    return reduce(DataFrame.unionAll, found)


def silver_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select(
        "customer_id", "customer_tenure_days", "days_since_last_purchase", "churn_risk_label")


def silver_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silver(spark, sf_dir).select("customer_id", "data_quality_flags")


def silver_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(_silver(spark, sf_dir))


def dq_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = inputs.customer_feed(spark, sf_dir)
    return plain(medallion.scorecard(feed, medallion.silver(feed, inputs.AS_OF)))


# Gold -------------------------------------------------------------------------

def _gold(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = medallion.gold(_silver(spark, sf_dir))[name]
        return plain(medallion.in_reading_order(name, table))
    return query


def medallion_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole flow through stored tables; returns the scorecard as read back."""
    paths = medallion.run(spark, inputs.customer_feed(spark, sf_dir),
                          work_folder(spark, "medallion"), inputs.BATCH_ID, inputs.INGESTED_AT,
                          inputs.AS_OF, "customers")
    score = spark.read.schema(
        "raw_record_count bigint, deduplicated_record_count bigint, duplicates_removed bigint, "
        "null_key_removed bigint, invalid_email_count bigint, revenue_anomaly_count bigint, "
        "churn_anomaly_count bigint, aov_mismatch_count bigint, clean_record_count bigint, "
        "clean_record_pct double").json(paths["data_quality_scorecard"])
    return score


# Rebuild ----------------------------------------------------------------------

def _rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.rebuild(inputs.raw_customers(spark, sf_dir), REBUILD_COLUMNS, ["customer_id"],
                            ["customer_name", "country", "status"],
                            [F.desc_nulls_last("last_updated_at")])


def drop_dup_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebuilt(spark, sf_dir)


def recovered_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.summary_by_country(_rebuilt(spark, sf_dir)).orderBy("country")


def recovered_gold_leftjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.summary_by_country_joined(_rebuilt(spark, sf_dir)).orderBy("country")


def rebuild_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.preview(inputs.raw_customers(spark, sf_dir), REBUILD_COLUMNS, ["customer_id"])


def publish_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuild, store, pass the gate, publish once; returns the published summary."""
    root = work_folder(spark, "publish")
    sources = {"customers_silver": f"{root}/rebuilt/silver",
               "customer_summary_gold": f"{root}/rebuilt/gold"}
    sinks.overwrite_parquet(_rebuilt(spark, sf_dir), sources["customers_silver"])
    silver = spark.read.parquet(sources["customers_silver"])
    sinks.overwrite_parquet(recovery.summary_by_country(silver), sources["customer_summary_gold"])

    request = [("INC-20240101-001", "REC-002")]
    schema = "incident_id string, strategy_id string"
    approved = spark.createDataFrame(
        [(*request[0], "APPROVED", "Data Owner", None, True)],
        f"{schema}, approval_status string, approved_by string, approved_at timestamp, "
        "execution_allowed boolean").drop("approved_at").withColumn(
            "approved_at", F.lit(inputs.INGESTED_AT).cast("timestamp"))
    passed = spark.createDataFrame([(request[0][0], "PASSED")],
                                   "incident_id string, verification_status string")
    asked = spark.createDataFrame(request, schema)
    names = {"incident": "incident_id", "strategy": "strategy_id"}
    records = approvals.authorize(asked, approved, passed, **names)
    registry, staging = f"{root}/registry", f"{root}/staged"
    gate = approvals.publish_gate(asked, records, sinks.published(spark, registry), True, True,
                                  **names)
    outcomes = [sinks.publish(spark, *request[0], gate, sources, staging, registry)
                for _ in range(2)]
    target = sinks.published(spark, registry).take(1)[0]["target"]
    return versions.read(spark, target, "customer_summary_gold").withColumns({
        "first_outcome": F.lit(outcomes[0]), "second_outcome": F.lit(outcomes[1])})


QUERIES = {
    "bronze_ingest": bronze_ingest,
    "csv_roundtrip_typed": csv_roundtrip_typed,
    "cast_failures": cast_failures,
    "latest_per_key": latest_per_key,
    "latest_event_per_user": latest_event_per_user,
    "silver_standardize": silver_standardize,
    "silver_email": silver_email,
    "silver_clamps": silver_clamps,
    "silver_aov_mismatch": silver_aov_mismatch,
    "silver_fx": silver_fx,
    "silver_fx_table": silver_fx_table,
    "silver_cast_flags": silver_cast_flags,
    "dq_scorecard_casts": dq_scorecard_casts,
    "publish_versions": publish_versions,
    "silver_derived": silver_derived,
    "silver_flags": silver_flags,
    "silver_full": silver_full,
    "dq_scorecard": dq_scorecard,
    "gold_customer_summary": _gold("customer_summary"),
    "gold_segment_performance": _gold("segment_performance"),
    "gold_loyalty_tiers": _gold("loyalty_tier_distribution"),
    "gold_churn_risk": _gold("churn_risk_summary"),
    "gold_acquisition_channels": _gold("acquisition_channel_performance"),
    "medallion_stored": medallion_stored,
    "drop_dup_rebuild": drop_dup_rebuild,
    "recovered_gold": recovered_gold,
    "recovered_gold_leftjoin": recovered_gold_leftjoin,
    "rebuild_preview": rebuild_preview,
    "publish_staged": publish_staged,
}


# Oracles ----------------------------------------------------------------------

SCORECARD = """
select r.raw_record_count, s.*, r.raw_record_count - s.deduplicated_record_count
    as duplicates_removed, r.null_key_removed,
  cast((2 * s.clean_record_count * 10000 + s.deduplicated_record_count)
    // (2 * s.deduplicated_record_count) as double) / 100 as clean_record_pct
from (select count(*) as raw_record_count,
        cast(count(*) filter (where customer_id is null) as bigint) as null_key_removed
      from raw_customers) r,
  (select count(*) as deduplicated_record_count,
     count(*) filter (where not is_valid_email) as invalid_email_count,
     count(*) filter (where negative) as revenue_anomaly_count,
     count(*) filter (where churn_off) as churn_anomaly_count,
     count(*) filter (where aov_off) as aov_mismatch_count,
     count(*) filter (where is_valid_email and not coalesce(negative, false)
       and not coalesce(churn_off, false) and not coalesce(aov_off, false)) as clean_record_count
   from evaluated) s
"""


def _mean(total: str, n: str, step: int) -> str:
    """Two-digit mean, halves away from zero, of units of which ``step`` make a cent."""
    return f"cast((2 * {total} + {n} * {step}) // (2 * {n} * {step}) as double) / 100"


def _sum(total: str) -> str:
    return f"cast((2 * {total} + 1000) // 2000 as double) / 100"


REBUILT = """
, rebuilt as (
  select customer_id, customer_name, country, status from (
    select *, row_number() over (partition by customer_id order by last_updated_at desc nulls last,
      customer_name nulls last, email nulls last, country nulls last) rn
    from raw_customers) where rn = 1)
"""

SUMMARY = """
select country, count(*) as total_customers,
  count(*) filter (where status = 'ACTIVE') as active_customers,
  count(*) filter (where status = 'INACTIVE') as inactive_customers
  {more}
from rebuilt group by country
"""

ORACLES = {
    "bronze_ingest": over("raw_customers", """
        select *, timestamp '2002-01-01 00:00:00' as ingestion_timestamp,
          'customers' as source_file_name, 'batch-0001' as ingestion_batch_id
        from raw_customers"""),
    "csv_roundtrip_typed": "select *, false as cast_failed, false as corrupt from customer",
    "cast_failures": """
        select o_orderpriority as value, cast(substring(o_orderpriority, 1, 1) as integer) as as_int,
          true as int_failed, false as date_failed, count(*) as n
        from orders group by o_orderpriority""",
    "latest_per_key": over("deduplicated", "select * from deduplicated"),
    "latest_event_per_user": """
        select event_id, ts, user_id, event_type, value, props from (
          select *, row_number() over (partition by user_id order by ts desc nulls last,
            event_id desc) rn from events) where rn = 1""",
    "silver_standardize": over("standardized", """
        select customer_id, customer_name, country, customer_segment, loyalty_tier, status
        from standardized"""),
    "silver_email": over("evaluated", "select customer_id, email, is_valid_email from evaluated"),
    "silver_clamps": over("evaluated", """
        select customer_id, cast(rev as double) / 100 as total_revenue,
          cast(churn as integer) as churn_risk_score, negative as is_revenue_anomaly,
          churn_off as is_churn_anomaly
        from evaluated"""),
    "silver_aov_mismatch": over("evaluated", """
        select customer_id, cast(total_orders as integer) as total_orders,
          cast(aov_micro as double) / 1000000 as avg_order_value_local, aov_off as is_aov_mismatch
        from evaluated"""),
    "silver_fx": over("silver", """
        select customer_id, currency, total_revenue_usd, avg_order_value_usd, lifetime_value_usd,
          is_high_value_customer from silver"""),
    "silver_fx_table": over("evaluated", """
        , r as (select *, case currency when 'USD' then 1000 when 'EUR' then 1080 when 'INR' then 12
            when 'JPY' then 7 end as known from evaluated)
        select customer_id, currency, cast(rev * coalesce(known, 1000) as double) / 100000 as total_revenue_usd,
          cast(lifetime_value_cents * coalesce(known, 1000) as double) / 100000 as lifetime_value_usd,
          lifetime_value_cents * coalesce(known, 1000) > 200000000 as is_high_value_customer,
          coalesce(nullif(concat_ws('|', case when not is_valid_email then 'INVALID_EMAIL' end,
            case when negative then 'NEGATIVE_REVENUE_CORRECTED' end,
            case when churn_off then 'CHURN_SCORE_OUT_OF_RANGE_CLAMPED' end,
            case when aov_off then 'AOV_MISMATCH_RECALCULATED' end,
            case when known is null then 'UNKNOWN_CURRENCY' end), ''), 'CLEAN') as data_quality_flags
        from r"""),
    "silver_cast_flags": over("evaluated", """
        select customer_id, case when customer_id % 23 <> 0 then cast(total_orders as integer) end as total_orders,
          case when customer_id % 29 <> 0 then registration_date end as registration_date,
          case when customer_id % 31 <> 0 then cast(lifetime_value_cents as double) / 100 end as lifetime_value,
          coalesce(nullif(concat_ws('|',
            case when customer_id % 23 = 0 or customer_id % 29 = 0 or customer_id % 31 = 0 then 'CAST_FAILED' end,
            case when not is_valid_email then 'INVALID_EMAIL' end,
            case when negative then 'NEGATIVE_REVENUE_CORRECTED' end,
            case when churn_off then 'CHURN_SCORE_OUT_OF_RANGE_CLAMPED' end,
            case when aov_off and customer_id % 23 <> 0 then 'AOV_MISMATCH_RECALCULATED' end), ''), 'CLEAN')
            as data_quality_flags
        from evaluated"""),
    "dq_scorecard_casts": over("raw_customers evaluated", """
        select (select count(*) from raw_customers) as raw_record_count,
          count(*) as deduplicated_record_count,
          count(*) filter (where not is_valid_email) as invalid_email_count,
          count(*) filter (where churn_off) as churn_anomaly_count,
          count(*) filter (where customer_id % 23 = 0 or customer_id % 29 = 0 or customer_id % 31 = 0)
            as cast_failed_count
        from evaluated"""),
    "publish_versions": over("silver", """
        , found as (
          select 1 as version, 'silver' as name, count(*) as n_rows from silver union all
          select 1, 'customer_summary', count(distinct country) from silver union all
          select 2, 'silver', count(*) from silver where data_quality_flags = 'CLEAN' union all
          select 2, 'customer_summary', count(distinct country) from silver where data_quality_flags = 'CLEAN')
        select r.run, found.* from (values (1, 1), (2, 1), (3, 2)) r(run, v) join found on found.version = r.v"""),
    "silver_derived": over("silver", """
        select customer_id, customer_tenure_days, days_since_last_purchase, churn_risk_label
        from silver"""),
    "silver_flags": over("silver", "select customer_id, data_quality_flags from silver"),
    "silver_full": over("silver",
                        "select * exclude (rev_units, aov_units, ltv_units) from silver"),
    "dq_scorecard": over("raw_customers evaluated", SCORECARD),
    "gold_customer_summary": over("silver", f"""
        select country, n as total_customers, active_customers, inactive_customers,
          churned_customers, {_sum('rev')} as total_revenue_usd,
          {_mean('ltv', 'n', 1000)} as avg_lifetime_value_usd, high_value_customers
        from (
          select country, count(*) as n, sum(rev_units) as rev, sum(ltv_units) as ltv,
            count(*) filter (where status = 'ACTIVE') as active_customers,
            count(*) filter (where status = 'INACTIVE') as inactive_customers,
            count(*) filter (where status = 'CHURNED') as churned_customers,
            count(*) filter (where is_high_value_customer) as high_value_customers
          from silver group by country)"""),
    "gold_segment_performance": over("silver", f"""
        select customer_segment, n as customer_count, {_sum('rev')} as total_revenue_usd,
          {_mean('aov', 'n', 10000000)} as avg_order_value_usd,
          {_mean('ltv', 'n', 1000)} as avg_lifetime_value_usd,
          cast((2 * churned * 10000 + n) // (2 * n) as double) / 100 as churn_rate_pct
        from (
          select customer_segment, count(*) as n, sum(rev_units) as rev, sum(ltv_units) as ltv,
            sum(aov_units) as aov, count(*) filter (where status = 'CHURNED') as churned
          from silver group by customer_segment)"""),
    "gold_loyalty_tiers": over("silver", f"""
        select loyalty_tier, n as customer_count, {_sum('rev')} as total_revenue_usd,
          cast((2 * n * 10000 + total) // (2 * total) as double) / 100 as pct_of_customer_base
        from (
          select loyalty_tier, count(*) as n, sum(rev_units) as rev,
            (select count(*) from silver) as total
          from silver group by loyalty_tier)"""),
    "gold_churn_risk": over("silver", f"""
        select churn_risk_label, n as customer_count, {_sum('rev')} as revenue_at_risk_usd,
          cast((2 * days * 10 + known) // (2 * known) as double) / 10
            as avg_days_since_last_purchase
        from (
          select churn_risk_label, count(*) as n, sum(rev_units) as rev,
            sum(days_since_last_purchase) as days, count(days_since_last_purchase) as known
          from silver group by churn_risk_label)"""),
    "gold_acquisition_channels": over("silver", f"""
        select acquisition_channel, n as customer_count, {_sum('rev')} as total_revenue_usd,
          {_mean('aov', 'n', 10000000)} as avg_order_value_usd, countries_reached
        from (
          select acquisition_channel, count(*) as n, sum(rev_units) as rev, sum(aov_units) as aov,
            count(distinct country) as countries_reached
          from silver group by acquisition_channel)"""),
    "medallion_stored": over("raw_customers evaluated", SCORECARD),
    "drop_dup_rebuild": over("raw_customers", REBUILT + "select * from rebuilt"),
    "recovered_gold": over("raw_customers", REBUILT + SUMMARY.format(more="")),
    "recovered_gold_leftjoin": over("raw_customers", REBUILT + SUMMARY.format(more="")),
    "rebuild_preview": over("raw_customers", """
        , extra as (select {} from raw_customers)
        select 'column' as kind, name, discarded from (unpivot extra on * into name name value
          discarded)
        union all
        select 'rows', 'customer_id', cast(count(*) - (select count(*) from
          (select distinct customer_id from raw_customers)) as bigint) from raw_customers
        """.format(", ".join(f"count({c}) as {c}" for c in [
            "email", "customer_segment", "loyalty_tier", "currency", "acquisition_channel",
            "total_orders", "total_revenue_cents", "avg_order_value_cents",
            "lifetime_value_cents", "churn_risk_score", "registration_date",
            "first_purchase_date", "last_purchase_date", "last_updated_at",
            "data_source_system"]))),
    "publish_staged": over("raw_customers", REBUILT + SUMMARY.format(
        more=", 'PUBLISHED' as first_outcome, 'ALREADY_PUBLISHED' as second_outcome")),
}
