"""Customer tables: bronze, silver, gold and the quality scorecard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import columns as X
from lakewarden.functions import exact
from lakewarden.operators import dedup, rules
from lakewarden.operators.rules import Rule
from lakewarden.sources import sinks

MONEY = "decimal(18,2)"
# Digits after the point of the money columns in silver.
USD_SCALE = 5
ORDER_VALUE_SCALE = 6
ORDER_VALUE_USD_SCALE = 9

SILVER_TYPES = {
    "marketing_opt_in": "boolean",
    "date_of_birth": "date",
    "registration_date": "date",
    "first_purchase_date": "date",
    "last_purchase_date": "date",
    "total_orders": "int",
    "returns_count": "int",
    "support_tickets_count": "int",
    "total_revenue": MONEY,
    "avg_order_value": MONEY,
    "lifetime_value": MONEY,
    "churn_risk_score": "int",
}


def _c(name: str) -> Column:
    return F.col(name)


# Bronze ---------------------------------------------------------------------

def bronze(raw: DataFrame, batch_id: str, ingested_at: str,
           source_file: str | None = None) -> DataFrame:
    """Raw rows plus ingestion time, file name and batch id.

    Without ``source_file`` the name of the file each row came from is used.
    """
    file_name = F.lit(source_file) if source_file else F.col("_metadata.file_name")
    values = [F.lit(ingested_at).cast("timestamp"), file_name, F.lit(batch_id)]
    return raw.withColumns(dict(zip(fixed.INGEST_COLUMNS, values)))


# Silver ---------------------------------------------------------------------

def deduplicate(bronze_rows: DataFrame) -> DataFrame:
    """Without ingestion columns and NULL keys; the latest row per customer."""
    rows = bronze_rows.drop(*fixed.INGEST_COLUMNS).withColumn(
        "last_updated_at", X.typed(_c("last_updated_at"), "timestamp"))
    return dedup.latest_by_key(rows, ["customer_id"], ["last_updated_at"])


def standardize(rows: DataFrame) -> DataFrame:
    """Free text in one spelling."""
    return rows.withColumns({
        "customer_name": F.trim("customer_name"),
        "country": X.standardize(_c("country")),
        "customer_segment": X.standardize(_c("customer_segment")),
        "loyalty_tier": X.or_label(X.standardize(_c("loyalty_tier")), fixed.NO_TIER_LABEL),
        "status": X.accepted(X.standardize(_c("status")), fixed.CUSTOMER_STATES),
    })


def set_types(rows: DataFrame, mark: str | None = None) -> DataFrame:
    """Declared types for the columns that are there; text that does not fit is NULL.

    With ``mark`` that column says in the same projection whether any value did not fit,
    a number beyond the declared digits included.
    """
    present = dict(rows.dtypes)
    typed = {n: (X.typed_text if present[n] == "string" else X.typed)(_c(n), t)
             for n, t in SILVER_TYPES.items() if n in present}
    if mark:
        typed[mark] = reduce(or_, [_c(n).isNotNull() & c.isNull() for n, c in typed.items()], F.lit(False))
    return rows.withColumns(typed)


CAST_RULE = Rule(fixed.FLAG_CAST_FAILED, lambda: _c(f"_broken_{fixed.FLAG_CAST_FAILED}"))
CURRENCY_RULE = Rule(fixed.FLAG_UNKNOWN_CURRENCY, lambda: _c("unknown_currency"))


def cast_failures(rows: DataFrame) -> DataFrame:
    """Per column, how many values do not fit the declared type (before ``set_types``)."""
    present = dict(rows.dtypes)
    failed = {n: (X.text_cast_failed if present[n] == "string" else X.cast_failed)(_c(n), t)
              for n, t in SILVER_TYPES.items() if n in present}
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in failed.items()])
    return counts.unpivot([], list(failed), "column", "failed")


def order_value() -> Column:
    """Revenue per order to six digits; 0 without orders."""
    per_order = _c("total_revenue") / _c("total_orders").cast("decimal(10,0)")
    return F.when(_c("total_orders") > 0, per_order).otherwise(F.lit(0)).cast(
        f"decimal(18,{ORDER_VALUE_SCALE})")


def customer_rules() -> list[Rule]:
    """The customer rules in the order in which they run and are joined."""
    return [
        Rule(fixed.FLAG_INVALID_EMAIL, lambda: ~X.is_email(_c("email"))),
        Rule(fixed.FLAG_NEGATIVE_REVENUE, lambda: _c("total_revenue") < 0,
             lambda: {"total_revenue": X.at_least(_c("total_revenue"), 0)}),
        Rule(fixed.FLAG_CHURN_RANGE, lambda: X.outside(_c("churn_risk_score"), 0, 100),
             lambda: {"churn_risk_score": X.within(_c("churn_risk_score"), 0, 100)}),
        Rule(fixed.FLAG_AOV_MISMATCH,
             lambda: X.ratio_mismatch(_c("avg_order_value"), _c("total_revenue"),
                                      _c("total_orders"), fixed.AOV_TOLERANCE_TENTHS),
             lambda: {"avg_order_value": order_value()}),
    ]


def to_usd(rows: DataFrame) -> DataFrame:
    """Local money columns get the suffix ``_local`` and a dollar column each.

    Rows that went through ``columns.fx_from_table`` bring their rate.
    """
    given = "rate_thousandths" in rows.columns
    rate = (_c("rate_thousandths") if given else X.fx_thousandths(_c("currency"))).cast("decimal(6,0)") * F.lit(Decimal("0.001"))
    scales = {"total_revenue": USD_SCALE, "avg_order_value": ORDER_VALUE_USD_SCALE,
              "lifetime_value": USD_SCALE}
    renamed = rows.withColumnsRenamed({n: f"{n}_local" for n in scales})
    return renamed.withColumns({
        f"{n}_usd": (_c(f"{n}_local") * rate).cast(f"decimal(24,{scale})")
        for n, scale in scales.items()})


def derive(rows: DataFrame, as_of: str) -> DataFrame:
    """Tenure, recency, high-value mark and churn label as of a fixed date."""
    return rows.withColumns({
        "customer_tenure_days": X.days_until(as_of, _c("registration_date")),
        "days_since_last_purchase": X.days_until(as_of, _c("last_purchase_date")),
        "is_high_value_customer": _c("lifetime_value_usd") > fixed.HIGH_VALUE_USD,
        "churn_risk_label": X.churn_label(_c("churn_risk_score")),
        "is_valid_email": X.is_email(_c("email")),
    })


def marked_silver(bronze_rows: DataFrame, as_of: str,
                  row_rules: Sequence[Rule] | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Silver rows that still carry one marker column per rule.

    ``CAST_RULE`` among the rules marks values that did not fit their type, which is seen
    before the cast; ``CURRENCY_RULE`` marks currencies that ``rates``, a table, does not have.
    """
    row_rules = customer_rules() if row_rules is None else row_rules
    typed = set_types(standardize(deduplicate(bronze_rows)), CAST_RULE.mark if CAST_RULE in row_rules else None)
    if rates is not None:
        typed = X.fx_from_table(typed, rates)
    return derive(to_usd(rules.evaluate(typed, row_rules)), as_of)


def silver(bronze_rows: DataFrame, as_of: str,
           row_rules: Sequence[Rule] | None = None, rates: DataFrame | None = None) -> DataFrame:
    """One clean, typed, corrected and flagged row per customer."""
    row_rules = customer_rules() if row_rules is None else row_rules
    return rules.collapse(marked_silver(bronze_rows, as_of, row_rules, rates), row_rules).drop(
        "rate_thousandths", "unknown_currency")


# Scorecard ------------------------------------------------------------------

SCORE_NAMES = {
    fixed.FLAG_INVALID_EMAIL: "invalid_email_count",
    fixed.FLAG_NEGATIVE_REVENUE: "revenue_anomaly_count",
    fixed.FLAG_CHURN_RANGE: "churn_anomaly_count",
    fixed.FLAG_AOV_MISMATCH: "aov_mismatch_count",
}


def _raw_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("raw_record_count"),
            F.count_if(_c("customer_id").isNull()).alias("null_key_removed")]


def _silver_counts(more: Mapping[str, str]) -> list[Column]:
    """Counted from the joined flags, so they also work on a stored silver table."""
    found = F.split(_c("data_quality_flags"), r"\|")
    return [F.count(F.lit(1)).alias("deduplicated_record_count"),
            *[F.count_if(F.array_contains(found, flag)).alias(name)
              for flag, name in {**SCORE_NAMES, **more}.items()],
            F.count_if(_c("data_quality_flags") == fixed.CLEAN_LABEL).alias("clean_record_count")]


def _with_rates(counts: DataFrame, more: Mapping[str, str]) -> DataFrame:
    return counts.withColumns({
        "duplicates_removed": _c("raw_record_count") - _c("deduplicated_record_count"),
        "clean_record_pct": rules.clean_share(_c("clean_record_count"),
                                              _c("deduplicated_record_count")),
    }).select("raw_record_count", "deduplicated_record_count", "duplicates_removed",
              "null_key_removed", *SCORE_NAMES.values(), *more.values(), "clean_record_count",
              "clean_record_pct")


def scorecard(bronze_rows: DataFrame, silver_rows: DataFrame, more: Mapping[str, str] | None = None) -> DataFrame:
    """One row of quality counts; each input is aggregated in one pass.

    ``more`` names further flags and the columns of their counts.
    """
    more = more or {}
    parts = bronze_rows.agg(*_raw_counts()).unionByName(
        silver_rows.agg(*_silver_counts(more)), allowMissingColumns=True)
    return _with_rates(parts.agg(*[F.sum(c).alias(c) for c in parts.columns]), more)


# Gold -----------------------------------------------------------------------

def _status_count(status: str) -> Column:
    return F.count_if(_c("status") == status)


def _usd_sum(name: str = "total_revenue_usd") -> Column:
    return exact.rounded_sum(_c(name), USD_SCALE, 2)


def by_country(rows: DataFrame) -> DataFrame:
    return rows.groupBy("country").agg(
        F.count(F.lit(1)).alias("total_customers"),
        _status_count("ACTIVE").alias("active_customers"),
        _status_count("INACTIVE").alias("inactive_customers"),
        _status_count("CHURNED").alias("churned_customers"),
        _usd_sum().alias("total_revenue_usd"),
        exact.rounded_mean(_c("lifetime_value_usd"), USD_SCALE, 2).alias("avg_lifetime_value_usd"),
        F.count_if("is_high_value_customer").alias("high_value_customers"))


def by_segment(rows: DataFrame) -> DataFrame:
    return rows.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        _usd_sum().alias("total_revenue_usd"),
        exact.rounded_mean(_c("avg_order_value_usd"), ORDER_VALUE_USD_SCALE, 2)
        .alias("avg_order_value_usd"),
        exact.rounded_mean(_c("lifetime_value_usd"), USD_SCALE, 2).alias("avg_lifetime_value_usd"),
        exact.percentage(_status_count("CHURNED"), F.count(F.lit(1))).alias("churn_rate_pct"))


def by_tier(rows: DataFrame) -> DataFrame:
    """Share of the base is taken over the few tier rows, without another job."""
    grouped = rows.groupBy("loyalty_tier").agg(
        F.count(F.lit(1)).alias("customer_count"),
        _usd_sum().alias("total_revenue_usd"))
    everyone = grouped.agg(F.sum("customer_count")).scalar()
    return grouped.withColumn("pct_of_customer_base",
                              exact.percentage(_c("customer_count"), everyone))


def by_churn_risk(rows: DataFrame) -> DataFrame:
    return rows.groupBy("churn_risk_label").agg(
        F.count(F.lit(1)).alias("customer_count"),
        _usd_sum().alias("revenue_at_risk_usd"),
        exact.rounded_mean(_c("days_since_last_purchase").cast("decimal(10,1)"), 1, 1)
        .alias("avg_days_since_last_purchase"))


def by_channel(rows: DataFrame) -> DataFrame:
    return rows.groupBy("acquisition_channel").agg(
        F.count(F.lit(1)).alias("customer_count"),
        _usd_sum().alias("total_revenue_usd"),
        exact.rounded_mean(_c("avg_order_value_usd"), ORDER_VALUE_USD_SCALE, 2)
        .alias("avg_order_value_usd"),
        F.count_distinct("country").alias("countries_reached"))


GOLD_TABLES = {
    "customer_summary": by_country,
    "segment_performance": by_segment,
    "loyalty_tier_distribution": by_tier,
    "churn_risk_summary": by_churn_risk,
    "acquisition_channel_performance": by_channel,
}

# How each gold table is read: by country, the others by revenue.
GOLD_ORDER = {
    "customer_summary": [("country", True)],
    "segment_performance": [("total_revenue_usd", False)],
    "loyalty_tier_distribution": [("total_revenue_usd", False)],
    "churn_risk_summary": [("revenue_at_risk_usd", False)],
    "acquisition_channel_performance": [("total_revenue_usd", False)],
}

GOLD_INPUT = ["country", "customer_segment", "loyalty_tier", "churn_risk_label",
              "acquisition_channel", "status", "total_revenue_usd", "avg_order_value_usd",
              "lifetime_value_usd", "days_since_last_purchase", "is_high_value_customer"]


def gold(silver_rows: DataFrame) -> dict[str, DataFrame]:
    """The five gold tables, from the eleven columns that they use."""
    rows = silver_rows.select(*GOLD_INPUT)
    return {name: build(rows) for name, build in GOLD_TABLES.items()}


def in_reading_order(name: str, table: DataFrame) -> DataFrame:
    return table.orderBy(*[F.col(c).asc() if up else F.col(c).desc()
                           for c, up in GOLD_ORDER[name]])


# Whole flow -----------------------------------------------------------------

def run(spark: SparkSession, raw: DataFrame, root: str, batch_id: str, ingested_at: str,
        as_of: str, source_file: str | None = None) -> dict[str, str]:
    """Write bronze, silver, scorecard and gold under ``root``; returns their paths.

    The scorecard reads two columns of the stored tables.  Counting while the
    data is written would save that, but counters under a shuffle are added to
    again when a lost executor's tasks are repeated.
    """
    paths = {n: f"{root}/{n}" for n in ("bronze", "silver", "scorecard")}
    sinks.overwrite_parquet(bronze(raw, batch_id, ingested_at, source_file), paths["bronze"])
    stored = spark.read.parquet(paths["bronze"])
    sinks.overwrite_parquet(silver(stored, as_of), paths["silver"])
    rows = spark.read.parquet(paths["silver"])
    sinks.write_record(scorecard(stored, rows), paths["scorecard"])
    for name, table in gold(rows).items():
        paths[name] = f"{root}/gold/{name}"
        sinks.overwrite_parquet(table, paths[name])
    paths["data_quality_scorecard"] = f"{root}/gold/data_quality_scorecard"
    sinks.copy_record(spark, paths["scorecard"], paths["data_quality_scorecard"])
    return paths
