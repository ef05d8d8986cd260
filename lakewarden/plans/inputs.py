"""Inputs of the registered queries, derived from the given tables.

The tables hold orders, customers, events and parts; these functions read them as
a customer master with noise, incidents, strategies, audit events, a lineage
graph and a changed copy of the orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2002-01-01"
BATCH_ID = "batch-0001"
INGESTED_AT = "2002-01-01 00:00:00"
SUPPLIER_KEYS = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(money: Column) -> Column:
    return F.round(money * 100).cast("bigint")


def _pick(key: Column, divisor: int, cases: dict[int, Column], other: Column) -> Column:
    out = None
    for rest, value in cases.items():
        hit = (key % divisor) == rest
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(other)


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals per customer."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(cents(F.col("o_totalprice"))).alias("rev_cents"),
        F.min("o_orderdate").cast("date").alias("first_d"),
        F.max("o_orderdate").cast("date").alias("last_d"),
        F.max("o_orderdate").cast("timestamp").alias("last_ts"))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer master with noise, stale duplicates and rows without a key.

    Suppliers are in it too, under keys of their own, as customers who never ordered.
    """
    columns = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"]
    customer = table(spark, sf_dir, "customer").select(*columns).unionAll(
        table(spark, sf_dir, "supplier").select(
            (F.col("s_suppkey") + SUPPLIER_KEYS).alias("c_custkey"), "s_name", "s_nationkey",
            F.lit("BUSINESS"), "s_acctbal"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    base = (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(customer_orders(spark, sf_dir), F.col("c_custkey") == F.col("o_custkey"), "left"))
    k, name, nat = F.col("c_custkey"), F.col("c_name"), F.col("n_name")
    key_text = k.cast("string")
    none = F.lit(None).cast("string")
    revenue = F.coalesce("rev_cents", F.lit(0))
    mean = F.call_function("div", F.col("rev_cents"), F.col("n_orders"))
    first = base.select(
        k.alias("customer_id"),
        F.when(k % 7 == 0, F.concat(F.lit("  "), name, F.lit(" "))).otherwise(name)
        .alias("customer_name"),
        _pick(k, 20, {0: none, 1: F.concat(F.lit("u"), key_text, F.lit("example.com")),
                      2: F.concat(F.lit("u"), key_text, F.lit("@example")), 3: F.lit("")},
              F.concat(F.lit("u"), key_text, F.lit("@example.com"))).alias("email"),
        _pick(k, 3, {0: F.lower(nat), 1: F.concat(F.lit(" "), nat)}, nat).alias("country"),
        _pick(k, 2, {0: F.lower("c_mktsegment")}, F.col("c_mktsegment")).alias("customer_segment"),
        F.when(k % 16 == 0, none).otherwise(
            _pick(k, 4, {0: F.lit("gold"), 1: F.lit(" SILVER"), 2: F.lit("Bronze")},
                  F.lit("PLATINUM"))).alias("loyalty_tier"),
        _pick(k, 9, {0: F.lit("inactive"), 1: F.lit("Suspended "), 2: F.lit("churned"),
                     3: F.lit("bogus"), 4: none}, F.lit("Active")).alias("status"),
        F.when(k % 50 == 0, F.lit("JPY")).when(k % 51 == 0, none).otherwise(
            _pick(k, 4, {0: F.lit("USD"), 1: F.lit("EUR"), 2: F.lit("GBP")}, F.lit("INR")))
        .alias("currency"),
        _pick(k, 3, {0: F.lit("Organic"), 1: F.lit("Referral")}, F.lit("Affiliate"))
        .alias("acquisition_channel"),
        F.coalesce("n_orders", F.lit(0)).alias("total_orders"),
        F.when(F.col("c_acctbal") < 0, -revenue).otherwise(revenue).alias("total_revenue_cents"),
        F.when(F.col("n_orders").isNull(), F.lit(0)).when(k % 25 == 4, mean * 2).otherwise(mean)
        .alias("avg_order_value_cents"),
        revenue.alias("lifetime_value_cents"),
        (k % 140 - 20).cast("int").alias("churn_risk_score"),
        F.coalesce("first_d", F.lit("1995-01-01").cast("date")).alias("registration_date"),
        F.col("first_d").alias("first_purchase_date"),
        F.col("last_d").alias("last_purchase_date"),
        F.coalesce("last_ts", F.lit("1995-01-01").cast("timestamp")).alias("last_updated_at"),
        F.lit("CRM_NEW").alias("data_source_system"))
    return first.select("*", F.explode(_copies()).alias("_copy")).withColumns({
        "customer_name": F.when(F.col("_copy") == "CRM_LEGACY", F.upper("customer_name"))
        .otherwise(F.col("customer_name")),
        "last_updated_at": F.when(F.col("_copy") == "CRM_LEGACY",
                                  F.col("last_updated_at") - F.expr("interval '1' day"))
        .otherwise(F.col("last_updated_at")),
        "customer_id": F.when(F.col("_copy") != "POS", F.col("customer_id")),
        "data_source_system": F.col("_copy"),
    }).drop("_copy")


def _copies() -> Column:
    """Which copies a customer row is sent in: as is, as a stale one, without key."""
    k = F.col("customer_id")
    return F.array_compact(F.array(
        F.lit("CRM_NEW"),
        F.when(k % 33 == 0, F.lit("CRM_LEGACY")),
        F.when(k % 200 == 9, F.lit("POS"))))


def customer_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_customers`` with money in units of currency, as a bronze input."""
    raw = raw_customers(spark, sf_dir)
    money = ["total_revenue", "avg_order_value", "lifetime_value"]
    return raw.withColumns({
        m: (F.col(f"{m}_cents").cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,2)")
        for m in money}).drop(*[f"{m}_cents" for m in money])


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per customer, with evidence as comma-joined column lists."""
    k = F.col("c_custkey")
    good = F.concat(F.lit("INC-"), (F.lit(20240101) + F.floor(k / 1000)).cast("string"), F.lit("-"),
                    F.lpad((k % 1000).cast("string"), 3, "0"))
    none = F.lit(None).cast("string")
    text = F.lit
    return table(spark, sf_dir, "customer").select(
        k.alias("incident_key"),
        _pick(k, 40, {0: F.lower(good), 1: F.concat(good, text("9"))}, good).alias("incident_id"),
        text("customer_gold_pipeline").alias("pipeline_name"),
        _pick(k, 3, {0: text("P1"), 1: text("P2")}, text("P3")).alias("severity"),
        _pick(k, 4, {3: text("NULL_VIOLATION")}, text("SCHEMA_DRIFT")).alias("error_type"),
        text("customer_id,status").alias("expected_columns"),
        _pick(k, 5, {0: text("customer_id"), 1: text("customer_id,status"),
                     2: text("customer_id,status,segment"), 3: text("customer_id,segment")},
              none).alias("actual_columns"),
        _pick(k, 5, {2: text("segment"), 3: text("segment")}, text("")).alias("unexpected_columns"),
        F.when(k % 15 == 0, text("")).otherwise(
            _pick(k, 5, {0: text("status"), 3: text("status")}, text(""))).alias("missing_columns"),
        _pick(k, 6, {0: none}, text("Source schema changed")).alias("root_cause"),
        _pick(k, 2, {0: text("PASSED")}, text("FAILED")).alias("post_execution_status"))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate strategy per order; its scope size is the number of lines."""
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n")))
    orders = table(spark, sf_dir, "orders")
    urgency = F.substring("o_orderpriority", 1, 1)
    price = F.col("o_totalprice")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_custkey").alias("incident_key"),
        F.col("o_orderkey").alias("strategy_key"),
        F.when(urgency.isin("1", "2"), F.lit("HIGH")).when(urgency == "3", F.lit("MEDIUM"))
        .when(urgency == "5", F.lit("LOW")).otherwise(F.lit("UNRATED")).alias("risk_level"),
        F.when(F.col("o_orderstatus") == "F", F.lit("HIGH"))
        .when(F.col("o_orderstatus") == "O", F.lit("MEDIUM")).otherwise(F.lit("LOW"))
        .alias("runtime_class"),
        F.when(price > 300000, F.lit("HIGH")).when(price > 100000, F.lit("MEDIUM"))
        .otherwise(F.lit("LOW")).alias("data_loss_risk"),
        F.coalesce("n", F.lit(0)).alias("scope_size"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as an audit log; a user is an incident."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("incident_key"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "signup", F.lit("approval_requested"))
        .when(kind == "purchase", F.lit("approval_granted"))
        .when(kind == "error", F.lit("approval_rejected"))
        .when(kind == "view", F.lit("verification_completed"))
        .otherwise(F.lit("agent_invoked")).alias("action"),
        _pick(F.col("event_id"), 3, {0: F.lit("PASSED"), 1: F.lit("BLOCKED")}, F.lit("REJECTED"))
        .alias("status"),
        F.concat(F.lit("actor"), (F.col("user_id") % 7).cast("string")).alias("actor"),
        "props")


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part numbers as a graph with shortcut edges; 1 is the source."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"))
    tree = part.filter("dst >= 2").select(F.floor(F.col("dst") / 2).alias("src"), "dst")
    shortcuts = (part.filter((F.col("dst") >= 4) & (F.col("dst") % 8 == 0))
                 .select(F.floor(F.col("dst") / 4).alias("src"), "dst"))
    return tree.union(shortcuts)


def orders_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        cents(F.col("o_totalprice")).alias("price_cents"), "o_orderdate")


def orders_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders with deletions, edits and duplicated rows."""
    key = F.col("o_orderkey")
    kept = orders_before(spark, sf_dir).filter(key % 97 != 0)
    edited = kept.withColumns({
        "o_orderstatus": F.when(key % 83 == 0, F.lower("o_orderstatus"))
        .otherwise(F.col("o_orderstatus")),
        "price_cents": F.when(key % 89 == 0, F.col("price_cents") + 1)
        .otherwise(F.col("price_cents"))})
    return edited.union(kept.filter(key % 101 == 0))


def feed_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One incident per order: its kind, and the supplier feeds that carry unexpected columns."""
    feeds = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(
        F.concat(F.lit("feed_"), F.col("l_suppkey").cast("string"))).alias("unexpected_columns"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(feeds, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("incident_key"),
        F.concat(F.lit("DRIFT_"), F.col("o_orderstatus")).alias("error_type"), "unexpected_columns",
        (F.col("o_orderpriority") < "3").alias("verified"))
