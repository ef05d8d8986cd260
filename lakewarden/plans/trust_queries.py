"""Queries on contracts, reconciliation and table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import collections as C
from lakewarden.operators import checks, contract, reconcile
from lakewarden.plans import inputs, medallion
from lakewarden.plans.oracle_inputs import over
from lakewarden.plans.shape import plain
from lakewarden.session import work_folder
from lakewarden.sources import sinks, tables

ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
ORDER_KEYS = ["o_orderkey"]
ORDER_STATES = ["F", "O", "P"]

# What each table was agreed to hold: one is left out, one is renamed in case,
# one has another type, one allows new columns.
AGREED = {
    "region": (["r_regionkey", "r_name"], False),
    "nation": (["n_nationkey", "N_NAME", "n_regionkey"], False),
    "customer": (["c_custkey", "c_name", "c_nationkey"], False),
    "supplier": (["s_suppkey", "s_name"], True),
    "part": (["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice", "p_comment"],
             False),
    "orders": (["o_orderkey", "o_custkey", "o_orderstatus", "o_clerk"], True),
    "lineitem": ([("l_orderkey", "bigint"), ("l_quantity", "decimal(12,2)")], True),
    "events": ([("ts", "timestamp_ntz"), ("event_id", "bigint"), ("user_id", "bigint"),
                ("event_type", "string"), ("value", "double"), ("props", "string")], False),
}

# The same tables as they are, for the SQL side.
ACTUAL_SQL = {
    "region": "r_regionkey int,r_name string",
    "nation": "n_nationkey int,n_name string,n_regionkey int",
    "customer": "c_custkey bigint,c_name string,c_nationkey int,c_acctbal double,"
                "c_mktsegment string",
    "supplier": "s_suppkey bigint,s_name string,s_nationkey int,s_acctbal double",
    "part": "p_partkey bigint,p_name string,p_brand string,p_type string,p_size int,"
            "p_retailprice double",
    "orders": "o_orderkey bigint,o_custkey bigint,o_orderstatus string,o_totalprice double,"
              "o_orderdate timestamp_ntz,o_orderpriority string",
    "lineitem": "l_orderkey bigint,l_partkey bigint,l_suppkey bigint,l_linenumber int,"
                "l_quantity double,l_extendedprice double,l_discount double,l_tax double,"
                "l_returnflag string,l_linestatus string,l_shipdate timestamp_ntz",
    "events": "event_id bigint,ts timestamp_ntz,user_id bigint,event_type string,value double,"
              "props string",
}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: inputs.table(spark, sf_dir, t) for t in ALL_TABLES}


def _agreed(spark: SparkSession) -> DataFrame:
    return contract.declare(spark, AGREED)


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column states, and how many values each column holds."""
    present = _tables(spark, sf_dir)
    changes = contract.diff(contract.schema_rows(spark, present), _agreed(spark))
    return changes.join(contract.filled(present).drop("n_rows"), ["table", "column"], "left")


# Contracts --------------------------------------------------------------------

def contract_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select("table", "column", "state", "non_null")


def contract_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver against the published customer contract, with the values it holds."""
    silver = {"silver.customers": medallion.silver(inputs.customer_feed(spark, sf_dir),
                                                   inputs.AS_OF)}
    agreed = contract.declare(
        spark, {"silver.customers": (fixed.CUSTOMER_CONTRACT_COLUMNS, False)})
    changes = contract.diff(contract.schema_rows(spark, silver), agreed).join(
        contract.filled(silver), ["table", "column"], "left")
    return plain(contract.verdict(changes, agreed, F.max("n_rows").alias("n_rows"),
                                  F.sum("non_null").alias("n_values")))


def contract_type_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).filter("state = 'type_changed'").drop("state")


def contract_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts taken from the present tables; full columns become required."""
    present = _tables(spark, sf_dir)
    return contract.require_values(contract.infer(spark, present), contract.filled(present))


def contract_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables against all contracts."""
    at_stake = F.sum(F.when(F.col("state") == "unexpected", F.col("non_null")).otherwise(0))
    return plain(contract.verdict(_diff(spark, sf_dir), _agreed(spark),
                                  at_stake.alias("unexpected_values")))


def contract_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract written from a table's schema as a document, read back and compared
    with the table after one column was renamed."""
    folder = work_folder(spark, "contract")
    orders = inputs.table(spark, sf_dir, "orders")
    names = contract.infer(spark, {"orders": orders}).agg(
        F.sort_array(F.collect_list(F.struct("position", "column"))).alias("c"))
    sinks.write_record(names.select(
        F.lit("orders_feed").alias("pipeline"), F.lit("orders").alias("source"),
        F.col("c.column").alias("expected_columns"), F.lit(False).alias("allow_new_columns")),
        folder)
    agreed = tables.read_contract(spark, folder).withColumn("type", F.lit(None).cast("string"))
    renamed = {"orders": orders.withColumnRenamed("o_orderpriority", "o_priority")}
    changes = contract.diff(contract.schema_rows(spark, renamed), agreed)
    return (changes.join(contract.filled(renamed), ["table", "column"], "left")
            .select("table", "column", "state", "non_null"))


def evidence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audited = contract.audit_evidence(evidence_lists(inputs.incidents(spark, sf_dir)))
    return plain(audited.select("incident_key", "derived_unexpected", "derived_missing",
                                "evidence_state"))


def evidence_lists(incidents: DataFrame) -> DataFrame:
    names = ["expected_columns", "actual_columns", "unexpected_columns", "missing_columns"]
    return incidents.withColumns({n: C.column_list(F.col(n)) for n in names})


# Reconciliation ---------------------------------------------------------------

def _before_after(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return inputs.orders_before(spark, sf_dir), inputs.orders_after(spark, sf_dir)


def reconcile_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(reconcile.set_diff(*_before_after(spark, sf_dir)))


def reconcile_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(reconcile.bag_diff(*_before_after(spark, sf_dir)))


def reconcile_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set difference after spelling the state in one case, on canonical types."""
    types = {"o_orderkey": "bigint", "o_orderstatus": "string", "price_cents": "bigint"}
    before, after = [reconcile.normalize(reconcile.canonical(t, types), ["o_orderstatus"])
                     for t in _before_after(spark, sf_dir)]
    return reconcile.set_diff(before, after)


def reconcile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy in which only keys of a few ranges changed."""
    before, after = _before_after(spark, sf_dir)
    local = F.col("o_orderkey") % 20_000 < 500
    mixed = after.filter(local).unionAll(before.filter(~local))
    return plain(reconcile.range_diff(before, mixed, "o_orderkey"))


def reconcile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy with a column less, one more and one retyped: columns, then keys that changed."""
    before, after = _before_after(spark, sf_dir)
    after = after.withColumns({"price_cents": F.col("price_cents").cast("string"), "channel": F.lit("web")}).drop(
        "o_orderdate")
    columns = reconcile.schema_changes(spark, before, after).select(
        F.lit("column").alias("kind"), F.col("column").alias("subject"), "change", F.lit("").alias("changed_columns"))
    rows = reconcile.keyed_diff(before, after, ORDER_KEYS).select(
        F.lit("row"), F.col("o_orderkey").cast("string"), "change", F.array_join("changed_columns", ","))
    return columns.unionAll(rows)


def reconcile_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(reconcile.keyed_diff(*_before_after(spark, sf_dir), ORDER_KEYS))


def reconcile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = _before_after(spark, sf_dir)
    return (reconcile.report(spark, *sides, "set", ["o_orderstatus"]).withColumn("mode", F.lit("set"))
            .union(reconcile.report(spark, *sides, "bag").withColumn("mode", F.lit("bag"))))


# Checks -----------------------------------------------------------------------

def check_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_keys(inputs.raw_customers(spark, sf_dir), ["customer_id"])


def check_duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicate_summary(inputs.raw_customers(spark, sf_dir), ["customer_id"])


REQUIRED = ["customer_id", "customer_name", "email", "status", "loyalty_tier", "currency",
            "first_purchase_date"]


def check_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.null_counts(inputs.raw_customers(spark, sf_dir), REQUIRED)


def check_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unaccepted_values(inputs.raw_customers(spark, sf_dir), {
        "status": ["Active", "inactive", "churned"], "currency": ["USD", "EUR", "GBP", "INR"]})


def check_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late events per user when events arrive in another order than they happened."""
    events = inputs.table(spark, sf_dir, "events").withColumn(
        "arrival", (F.col("event_id") * 7919) % 10007)
    late = checks.late_rows(events, ["user_id"], ["arrival", "event_id"], "ts",
                            "1 day")
    return plain(late.select("event_id", "user_id", "seen_until", "late"))


def check_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.raw_customers(spark, sf_dir)
    return checks.combined_failures(rows, [
        ("no_key", F.col("customer_id").isNull()),
        ("no_email", F.col("email").isNull()),
        ("negative_revenue", F.col("total_revenue_cents") < 0),
        ("churn_range", ~F.col("churn_risk_score").between(0, 100)),
        ("no_orders", F.col("total_orders") == 0)])


def check_ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose order is gone after the change, and orders without a customer."""
    lines = inputs.table(spark, sf_dir, "lineitem")
    after = inputs.orders_after(spark, sf_dir)
    orders = inputs.table(spark, sf_dir, "orders")
    customers = inputs.table(spark, sf_dir, "customer")
    return (checks.orphans(lines, "l_orderkey", after, "o_orderkey")
            .select(F.lit("lineitem").alias("child"), "key", "n_rows")
            .union(checks.orphans(orders, "o_custkey", customers, "c_custkey")
                   .select(F.lit("orders"), "key", "n_rows")))


def check_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = inputs.table(spark, sf_dir, "events")
    orders = inputs.table(spark, sf_dir, "orders")
    return checks.run([checks.check_freshness(events, "ts", "2024-01-31", "1 day"),
                       checks.check_freshness(orders, "o_orderdate", "2024-01-31", "1 day")])


def check_rowcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _before_after(spark, sf_dir)
    return checks.run([checks.check_row_count(after, before),
                       checks.check_row_count(after, before, percent=1)])


def _customer_totals(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.sum("price_cents").alias("total_cents"),
                                           F.count(F.lit(1)).alias("n_orders"))


def check_business_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer totals before the change against totals of the changed orders."""
    before, after = _before_after(spark, sf_dir)
    return checks.run([checks.check_rederived(_customer_totals(before), _customer_totals(after)),
                       checks.check_rederived(_customer_totals(before), _customer_totals(before))])


def _suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _before_after(spark, sf_dir)
    agreed = contract.infer(spark, {"orders": before})
    verdicts = contract.verdict(
        contract.diff(contract.schema_rows(spark, {"orders": after}), agreed), agreed)
    return checks.run([
        checks.check_contract(verdicts),
        checks.check_all(after, before, "o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus"],
                         "o_orderdate", inputs.AS_OF, "1000 days", inputs.table(spark, sf_dir, "lineitem"),
                         "l_orderkey", "o_custkey", "price_cents")])


def checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite(spark, sf_dir)


def checklist_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.overall(_suite(spark, sf_dir))


QUERIES = {
    "contract_diff": contract_diff,
    "contract_verdict": contract_verdict,
    "contract_type_drift": contract_type_drift,
    "contract_infer": contract_infer,
    "contract_sweep": contract_sweep,
    "contract_document": contract_document,
    "evidence_audit": evidence_audit,
    "reconcile_set": reconcile_set,
    "reconcile_bag": reconcile_bag,
    "reconcile_normalized": reconcile_normalized,
    "reconcile_ranges": reconcile_ranges,
    "reconcile_drift": reconcile_drift,
    "reconcile_keyed": reconcile_keyed,
    "reconcile_report": reconcile_report,
    "check_duplicates": check_duplicates,
    "check_duplicate_summary": check_duplicate_summary,
    "check_nulls": check_nulls,
    "check_enum": check_enum,
    "check_late": check_late,
    "check_combined": check_combined,
    "check_ref_integrity": check_ref_integrity,
    "check_freshness": check_freshness,
    "check_rowcount": check_rowcount,
    "check_business_rules": check_business_rules,
    "checklist": checklist,
    "checklist_status": checklist_status,
}


# Oracles ----------------------------------------------------------------------

def _values(rows: list[tuple]) -> str:
    def lit(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        return str(v) if isinstance(v, int) else "'" + v + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_ACTUAL_ROWS = [(t, i, *c.split(" ")) for t, text in ACTUAL_SQL.items()
                for i, c in enumerate(text.split(","))]
_AGREED_ROWS = [(t, *((c, None) if isinstance(c, str) else c), new)
                for t, (cols, new) in AGREED.items() for c in cols]

# Values per column, counted by name.
_FILLED = "\nunion all\n".join(
    f"select '{t}' as tbl, '{c}' as col, count(*) as n_rows, count({c}) as non_null from {t}"
    for t, _, c, _ in _ACTUAL_ROWS)

SCHEMAS = f"""
with actual(tbl, pos, col, typ) as (values {_values(_ACTUAL_ROWS)}),
agreed(tbl, col, typ, allow_new) as (values {_values(_AGREED_ROWS)}),
filled as ({_FILLED}),
changes as (
  select coalesce(a.tbl, g.tbl) as tbl, coalesce(a.col, g.col) as col, a.typ as actual_type,
    g.typ as expected_type, f.non_null,
    case when g.col is null then 'unexpected' when a.col is null then 'missing'
      when a.typ <> g.typ then 'type_changed' else 'ok' end as state
  from actual a full join agreed g on a.tbl = g.tbl and a.col = g.col
  left join filled f on f.tbl = a.tbl and f.col = a.col)
"""

AUDITED = """
, lists as (
  select incident_key, str_split(expected_columns, ',') as e, str_split(actual_columns, ',') as a,
    case when unexpected_columns = '' then [] else str_split(unexpected_columns, ',') end as u,
    case when missing_columns = '' then [] else str_split(missing_columns, ',') end as m
  from incidents),
derived as (
  select *, [x for x in a if not list_contains(e, x)] as du,
    [x for x in e if not list_contains(a, x)] as dm
  from lists),
audited as (
  select incident_key, array_to_string(du, ',') as derived_unexpected,
    case when a is not null then array_to_string(dm, ',') end as derived_missing,
    case when a is null or e is null then 'malformed'
      when list_sort(du) = list_sort(u) and list_sort(dm) = list_sort(m) then 'consistent'
      else 'conflicting' end as evidence_state
  from derived)
"""

_BAG = """
, counted as (
  select o_orderkey, o_custkey, o_orderstatus, price_cents, o_orderdate, sum(b) as b, sum(a) as a
  from (select *, 1 as b, 0 as a from orders_before union all
        select *, 0, 1 from orders_after)
  group by all)
"""

_TOTALS = """
, totals_before as (select o_custkey, sum(price_cents) as t, count(*) as n from orders_before
  group by o_custkey),
totals_after as (select o_custkey, sum(price_cents) as t, count(*) as n from orders_after
  group by o_custkey),
total_gaps as (select count(*) as n from (
  (select * from totals_before except all select * from totals_after) union all
  (select * from totals_after except all select * from totals_before)))
"""

_CHECKLIST = _TOTALS + """
, results as (
  select 'schema_contract' as "check", 'PASSED' as status, '0' as observed, '0' as expected
  union all
  select 'row_count', case when a = b then 'PASSED' else 'FAILED' end, cast(a as varchar),
    cast(b as varchar)
  from (select (select count(*) from orders_after) as a, (select count(*) from orders_before) as b)
  union all
  select 'null_check', case when n = 0 then 'PASSED' else 'FAILED' end, cast(n as varchar), '0'
  from (select count(*) as n from orders_after
        where o_orderkey is null or o_custkey is null or o_orderstatus is null)
  union all
  select 'duplicate_check', case when n = 0 then 'PASSED' else 'FAILED' end, cast(n as varchar), '0'
  from (select count(*) - count(distinct o_orderkey) as n from orders_after)
  union all
  select 'referential_integrity', case when n = 0 then 'PASSED' else 'FAILED' end,
    cast(n as varchar), '0'
  from (select count(*) as n from lineitem
        where l_orderkey not in (select o_orderkey from orders_after))
  union all
  select 'business_rules', case when n = 0 then 'PASSED' else 'FAILED' end, cast(n as varchar), '0'
  from total_gaps
  union all
  select 'freshness', case when t >= timestamp '2002-01-01' - interval '1000 days' then 'PASSED'
    else 'FAILED' end, cast(t as varchar),
    cast(timestamp '2002-01-01' - interval '1000 days' as varchar)
  from (select max(o_orderdate) as t from orders_after))
"""

_VERDICT = """
select tbl as "table",
  coalesce(string_agg(case when state = 'unexpected' then col end, ',' order by col), '')
    as unexpected_columns,
  coalesce(string_agg(case when state = 'missing' then col end, ',' order by col), '')
    as missing_columns,
  coalesce(string_agg(case when state = 'type_changed' then col end, ',' order by col), '')
    as type_changed_columns,
  allow_new_columns,
  case when count(*) filter (where state = 'unexpected') > 0 and not allow_new_columns
    then 'SCHEMA DRIFT DETECTED'
  when count(*) filter (where state = 'missing') > 0
    then 'SCHEMA CONTRACT VIOLATION: MISSING COLUMNS' else 'SCHEMA CONTRACT PASSED' end as verdict,
  cast(coalesce(sum(case when state = 'unexpected' then non_null end), 0) as bigint)
    as unexpected_values
from {changes} group by tbl, allow_new_columns
"""

_FEED_COLUMNS = [
    "customer_id", "customer_name", "email", "country", "customer_segment", "loyalty_tier",
    "status", "currency", "acquisition_channel", "total_orders", "churn_risk_score",
    "registration_date", "first_purchase_date", "last_purchase_date", "last_updated_at",
    "data_source_system", "total_revenue_local", "avg_order_value_local", "lifetime_value_local",
    "total_revenue_usd", "avg_order_value_usd", "lifetime_value_usd", "customer_tenure_days",
    "days_since_last_purchase", "is_high_value_customer", "churn_risk_label", "is_valid_email",
    "data_quality_flags"]

_GONE = [c for c in fixed.CUSTOMER_CONTRACT_COLUMNS if c not in _FEED_COLUMNS]

ORACLES = {
    "contract_diff": SCHEMAS + """
        select tbl as "table", col as "column", state, non_null from changes""",
    "contract_verdict": over("silver", f"""
        select 'silver.customers' as "table", '' as unexpected_columns,
          '{",".join(sorted(_GONE))}' as missing_columns, '' as type_changed_columns,
          false as allow_new_columns, 'SCHEMA CONTRACT VIOLATION: MISSING COLUMNS' as verdict,
          count(*) as n_rows, cast({" + ".join(f"count({c})" for c in _FEED_COLUMNS)} as bigint)
            as n_values
        from silver"""),
    "contract_type_drift": SCHEMAS + """
        select tbl as "table", col as "column", actual_type, expected_type, non_null from changes
        where state = 'type_changed'""",
    "contract_infer": SCHEMAS + """
        select a.tbl as "table", cast(pos as integer) as position, a.col as "column", typ as type,
          false as allow_new_columns, non_null < n_rows as nullable
        from actual a join filled f on f.tbl = a.tbl and f.col = a.col""",
    "contract_sweep": SCHEMAS + _VERDICT.format(changes="""(
        select c.*, g.allow_new as allow_new_columns from changes c
        join (select distinct tbl, allow_new from agreed) g on c.tbl = g.tbl)"""),
    "contract_document": """
        select 'orders' as "table", c as "column", 'ok' as state, n as non_null from (
          unpivot (select count(o_orderkey) as o_orderkey, count(o_custkey) as o_custkey,
            count(o_orderstatus) as o_orderstatus, count(o_totalprice) as o_totalprice,
            count(o_orderdate) as o_orderdate from orders) on * into name c value n)
        union all
        select 'orders', 'o_priority', 'unexpected', count(o_orderpriority) from orders
        union all
        select 'orders', 'o_orderpriority', 'missing', null""",
    "evidence_audit": over("incidents", AUDITED + "select * from audited"),
    "reconcile_set": over("orders_before orders_after", """
        select *, 'added' as change from (select * from orders_after except
          select * from orders_before)
        union all
        select *, 'removed' from (select * from orders_before except select * from orders_after)"""),
    "reconcile_bag": over("orders_before orders_after", """
        select *, 'added' as change, count(*) as copies from (select * from orders_after except all
          select * from orders_before) group by all
        union all
        select *, 'removed', count(*) from (select * from orders_before except all
          select * from orders_after) group by all"""),
    "reconcile_normalized": over("orders_before orders_after", """
        , b as (select o_orderkey, upper(o_orderstatus) as o_orderstatus, price_cents
          from orders_before),
        a as (select o_orderkey, upper(o_orderstatus) as o_orderstatus, price_cents
          from orders_after)
        select *, 'added' as change from (select * from a except select * from b)
        union all
        select *, 'removed' from (select * from b except select * from a)"""),
    "reconcile_ranges": over("orders_before orders_after", """
        , mixed as (select * from orders_after where o_orderkey % 20000 < 500
          union all select * from orders_before where o_orderkey % 20000 >= 500)
        select *, 'added' as change, count(*) as copies from (select * from mixed except all
          select * from orders_before) group by all
        union all
        select *, 'removed', count(*) from (select * from orders_before except all
          select * from mixed) group by all"""),
    "reconcile_drift": over("orders_before orders_after", """
        , b as (select o_orderkey, any_value(o_orderstatus) as s, any_value(price_cents) as p, count(*) as n
          from orders_before group by 1),
        a as (select o_orderkey, min(o_orderstatus) as s1, max(o_orderstatus) as s2, min(price_cents) as p1,
          max(price_cents) as p2, count(*) as n from orders_after group by 1),
        pairs as (select b.o_orderkey as k, a.n as na, b.n as nb, coalesce(s <> s1 and s <> s2, false) as cs,
          coalesce(p <> p1 and p <> p2, false) as cp from b left join a on a.o_orderkey = b.o_orderkey)
        select 'column' as kind, subject, change, '' as changed_columns from (values
          ('o_orderdate', 'removed'), ('channel', 'added'), ('price_cents', 'retyped')) t(subject, change)
        union all
        select 'row', cast(k as varchar), case when na is null then 'removed' when cs or cp then 'changed'
            else 'repeated' end,
          concat_ws(',', case when cs then 'o_orderstatus' end, case when cp then 'price_cents' end)
        from pairs where na is null or na <> nb or cs or cp"""),
    "reconcile_keyed": over("orders_before orders_after", """
        , a as (
          select o_orderkey, count(*) as n_after, count(distinct (o_orderstatus, price_cents)) as v,
            list(o_custkey) as k, list(o_orderstatus) as s, list(price_cents) as p,
            list(o_orderdate) as d
          from orders_after group by o_orderkey),
        j as (
          select coalesce(b.o_orderkey, a.o_orderkey) as o_orderkey,
            cast(case when b.o_orderkey is null then 0 else 1 end as bigint) as n_before,
            coalesce(n_after, 0) as n_after, b.o_orderstatus as s0, b.price_cents as p0,
            b.o_custkey as k0, b.o_orderdate as d0, s, p, k, d
          from orders_before b full join a on a.o_orderkey = b.o_orderkey),
        c as (
          select *, case when n_before = 0 or n_after = 0 then '' else concat_ws(',',
            case when not list_contains(k, k0) then 'o_custkey' end,
            case when not list_contains(d, d0) then 'o_orderdate' end,
            case when not list_contains(s, s0) then 'o_orderstatus' end,
            case when not list_contains(p, p0) then 'price_cents' end) end as gone
          from j)
        select o_orderkey, n_before, n_after,
          case when n_before = 0 then 'added' when n_after = 0 then 'removed'
            when gone <> '' then 'changed' else 'repeated' end as change,
          gone as changed_columns
        from c where n_before <> n_after or gone <> ''"""),
    "reconcile_report": over("orders_before orders_after", _BAG + """
        select true as schema_match, b = a as row_count_match, x = 0 and r = 0 as values_match,
          b as before_rows, a as after_rows, x as added_records, r as removed_records,
          case when b = a and x = 0 and r = 0 then 'PASSED' else 'FAILED' end as status, mode
        from (
          select 'bag' as mode, cast(sum(b) as bigint) as b, cast(sum(a) as bigint) as a,
            cast(sum(greatest(a - b, 0)) as bigint) as x,
            cast(sum(greatest(b - a, 0)) as bigint) as r
          from counted
          union all
          select 'set', cast(sum(b) as bigint), cast(sum(a) as bigint),
            count(*) filter (where b = 0), count(*) filter (where a = 0)
          from (select o_orderkey, o_custkey, upper(o_orderstatus) as s, price_cents, o_orderdate,
              sum(b) as b, sum(a) as a from counted group by all))"""),
    "check_duplicates": over("raw_customers", """
        select customer_id, count(*) as n from raw_customers group by customer_id
        having count(*) > 1"""),
    "check_duplicate_summary": over("raw_customers", """
        select count(*) as duplicate_keys, cast(sum(n - 1) as bigint) as surplus_rows
        from (select count(*) as n from raw_customers group by customer_id having count(*) > 1)"""),
    "check_nulls": over("raw_customers", "\nunion all\n".join(
        f"select '{c}' as \"column\", count(*) - count({c}) as null_count from raw_customers"
        for c in REQUIRED)),
    "check_enum": over("raw_customers", """
        select 'status' as "column", status as value, count(*) as n from raw_customers
        where status is null or status not in ('Active', 'inactive', 'churned') group by status
        union all
        select 'currency', currency, count(*) from raw_customers
        where currency is null or currency not in ('USD', 'EUR', 'GBP', 'INR')
        group by currency"""),
    "check_late": """
        select event_id, user_id, seen_until, coalesce(ts < seen_until - interval '1 day', false)
          as late
        from (
          select *, max(ts) over (partition by user_id order by (event_id * 7919) % 10007, event_id
            rows between unbounded preceding and 1 preceding) as seen_until
          from events)""",
    "check_combined": over("raw_customers", """
        select failures, cast(len(str_split(failures, '|')) as integer) as n_failures,
          count(*) as n_rows
        from (
          select concat_ws('|', case when customer_id is null then 'no_key' end,
            case when email is null then 'no_email' end,
            case when total_revenue_cents < 0 then 'negative_revenue' end,
            case when churn_risk_score not between 0 and 100 then 'churn_range' end,
            case when total_orders = 0 then 'no_orders' end) as failures
          from raw_customers)
        where failures <> '' group by failures"""),
    "check_ref_integrity": over("orders_after", """
        select 'lineitem' as child, l_orderkey as key, count(*) as n_rows from lineitem
        where l_orderkey not in (select o_orderkey from orders_after) group by l_orderkey
        union all
        select 'orders', o_custkey, count(*) from orders
        where o_custkey not in (select c_custkey from customer) group by o_custkey"""),
    "check_freshness": """
        select 'freshness' as "check", case when t >= timestamp '2024-01-30' then 'PASSED'
          else 'FAILED' end as status, cast(t as varchar) as observed,
          '2024-01-30 00:00:00' as expected
        from (select max(ts) as t from events union all select max(o_orderdate) from orders)""",
    "check_rowcount": over("orders_before orders_after", """
        select 'row_count' as "check", case when abs(a - b) * 100 <= tol * b then 'PASSED' else 'FAILED' end
          as status, cast(a as varchar) as observed, cast(b as varchar) as expected
        from (select (select count(*) from orders_after) as a,
            (select count(*) from orders_before) as b),
          (values (0), (1)) t(tol)"""),
    "check_business_rules": over("orders_before orders_after", _TOTALS + """
        select 'business_rules' as "check", case when n = 0 then 'PASSED' else 'FAILED' end
          as status, cast(n as varchar) as observed, '0' as expected
        from (select n from total_gaps union all select 0)"""),
    "checklist": over("orders_before orders_after", _CHECKLIST + "select * from results"),
    "checklist_status": over("orders_before orders_after", _CHECKLIST + """
        select count(*) as checks_run, count(*) filter (where status <> 'PASSED') as failed_checks,
          case when count(*) filter (where status <> 'PASSED') = 0 then 'PASSED' else 'FAILED' end
            as verification_status
        from results"""),
}
