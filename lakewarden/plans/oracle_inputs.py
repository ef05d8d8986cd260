"""The derived inputs of the oracle queries, as SQL over the given tables."""

from __future__ import annotations

RAW_CUSTOMERS = """
with oa as (
  select o_custkey, cast(count(*) as bigint) as n_orders,
         cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as rev_cents,
         min(cast(o_orderdate as date)) as first_d, max(cast(o_orderdate as date)) as last_d,
         max(o_orderdate) as last_ts
  from orders group by o_custkey),
b as (
  select c.c_custkey as k, c.*, n.n_name, oa.*
  from (select c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal from customer
    union all select s_suppkey + 1000000000000, s_name, s_nationkey, 'BUSINESS', s_acctbal
    from supplier) c join nation n on c.c_nationkey = n.n_nationkey
  left join oa on c.c_custkey = oa.o_custkey),
one as (
  select k as customer_id,
    case when k % 7 = 0 then concat('  ', c_name, ' ') else c_name end as customer_name,
    case k % 20 when 0 then null when 1 then concat('u', cast(k as varchar), 'example.com')
      when 2 then concat('u', cast(k as varchar), '@example') when 3 then ''
      else concat('u', cast(k as varchar), '@example.com') end as email,
    case k % 3 when 0 then lower(n_name) when 1 then concat(' ', n_name) else n_name end as country,
    case when k % 2 = 0 then lower(c_mktsegment) else c_mktsegment end as customer_segment,
    case when k % 16 = 0 then null when k % 4 = 0 then 'gold' when k % 4 = 1 then ' SILVER'
      when k % 4 = 2 then 'Bronze' else 'PLATINUM' end as loyalty_tier,
    case k % 9 when 0 then 'inactive' when 1 then 'Suspended ' when 2 then 'churned'
      when 3 then 'bogus' when 4 then null else 'Active' end as status,
    case when k % 50 = 0 then 'JPY' when k % 51 = 0 then null when k % 4 = 0 then 'USD'
      when k % 4 = 1 then 'EUR' when k % 4 = 2 then 'GBP' else 'INR' end as currency,
    case k % 3 when 0 then 'Organic' when 1 then 'Referral' else 'Affiliate' end
      as acquisition_channel,
    coalesce(n_orders, 0) as total_orders,
    case when c_acctbal < 0 then -coalesce(rev_cents, 0) else coalesce(rev_cents, 0) end
      as total_revenue_cents,
    case when n_orders is null then 0
         when k % 25 = 4 then cast(floor(rev_cents / n_orders) as bigint) * 2
         else cast(floor(rev_cents / n_orders) as bigint) end as avg_order_value_cents,
    coalesce(rev_cents, 0) as lifetime_value_cents,
    cast(k % 140 - 20 as int) as churn_risk_score,
    coalesce(first_d, date '1995-01-01') as registration_date,
    first_d as first_purchase_date, last_d as last_purchase_date,
    coalesce(last_ts, timestamp '1995-01-01 00:00:00') as last_updated_at,
    'CRM_NEW' as data_source_system
  from b)
select * from one
union all
select customer_id, upper(customer_name), email, country, customer_segment, loyalty_tier, status,
  currency, acquisition_channel, total_orders, total_revenue_cents, avg_order_value_cents,
  lifetime_value_cents, churn_risk_score, registration_date, first_purchase_date,
  last_purchase_date, last_updated_at - interval '1' day, 'CRM_LEGACY'
from one where customer_id % 33 = 0
union all
select cast(null as bigint), customer_name, email, country, customer_segment, loyalty_tier, status,
  currency, acquisition_channel, total_orders, total_revenue_cents, avg_order_value_cents,
  lifetime_value_cents, churn_risk_score, registration_date, first_purchase_date,
  last_purchase_date, last_updated_at, 'POS'
from one where customer_id % 200 = 9
"""

INCIDENTS = """
with b as (
  select c_custkey as k,
    concat('INC-', cast(20240101 + cast(floor(c_custkey / 1000) as bigint) as varchar), '-',
           lpad(cast(c_custkey % 1000 as varchar), 3, '0')) as good
  from customer)
select k as incident_key,
  case k % 40 when 0 then lower(good) when 1 then concat(good, '9') else good end as incident_id,
  'customer_gold_pipeline' as pipeline_name,
  case k % 3 when 0 then 'P1' when 1 then 'P2' else 'P3' end as severity,
  case when k % 4 = 3 then 'NULL_VIOLATION' else 'SCHEMA_DRIFT' end as error_type,
  'customer_id,status' as expected_columns,
  case k % 5 when 0 then 'customer_id' when 1 then 'customer_id,status'
    when 2 then 'customer_id,status,segment' when 3 then 'customer_id,segment' else null end
    as actual_columns,
  case k % 5 when 2 then 'segment' when 3 then 'segment' else '' end as unexpected_columns,
  case when k % 15 = 0 then '' when k % 5 = 0 then 'status' when k % 5 = 3 then 'status' else '' end
    as missing_columns,
  case when k % 6 = 0 then null else 'Source schema changed' end as root_cause,
  case when k % 2 = 0 then 'PASSED' else 'FAILED' end as post_execution_status
from b
"""

STRATEGIES = """
with li as (select l_orderkey, cast(count(*) as bigint) as n from lineitem group by l_orderkey)
select o_custkey as incident_key, o_orderkey as strategy_key,
  case substring(o_orderpriority, 1, 1) when '1' then 'HIGH' when '2' then 'HIGH'
    when '3' then 'MEDIUM' when '5' then 'LOW' else 'UNRATED' end as risk_level,
  case o_orderstatus when 'F' then 'HIGH' when 'O' then 'MEDIUM' else 'LOW' end as runtime_class,
  case when o_totalprice > 300000 then 'HIGH' when o_totalprice > 100000 then 'MEDIUM'
    else 'LOW' end as data_loss_risk,
  coalesce(n, 0) as scope_size
from orders left join li on o_orderkey = l_orderkey
"""

AUDIT_EVENTS = """
select event_id, user_id as incident_key, ts,
  case event_type when 'signup' then 'approval_requested' when 'purchase' then 'approval_granted'
    when 'error' then 'approval_rejected' when 'view' then 'verification_completed'
    else 'agent_invoked' end as action,
  case event_id % 3 when 0 then 'PASSED' when 1 then 'BLOCKED' else 'REJECTED' end as status,
  concat('actor', cast(user_id % 7 as varchar)) as actor, props
from events
"""

LINEAGE_EDGES = """
select cast(floor(p_partkey / 2) as bigint) as src, p_partkey as dst from part where p_partkey >= 2
union all
select cast(floor(p_partkey / 4) as bigint) as src, p_partkey as dst from part
where p_partkey >= 4 and p_partkey % 8 = 0
"""

ORDERS_BEFORE = """
select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as price_cents,
  o_orderdate
from orders
"""

ORDERS_AFTER = """
select o_orderkey, o_custkey,
  case when o_orderkey % 83 = 0 then lower(o_orderstatus) else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 89 = 0 then cast(round(o_totalprice * 100) as bigint) + 1
    else cast(round(o_totalprice * 100) as bigint) end as price_cents, o_orderdate
from orders where o_orderkey % 97 <> 0
union all
select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint), o_orderdate
from orders where o_orderkey % 101 = 0 and o_orderkey % 97 <> 0
"""

FEED_TOKENS = """
select o_orderkey as incident_key, concat('DRIFT_', o_orderstatus) as token from orders
union
select o_orderkey, concat('feed_', l_suppkey) from orders join lineitem on l_orderkey = o_orderkey
"""

# The latest row per customer.
DEDUPLICATED = """
select * exclude (rn) from (
  select *, row_number() over (partition by customer_id order by last_updated_at desc nulls last) rn
  from raw_customers where customer_id is not null)
where rn = 1
"""

STANDARDIZED = """
select * replace (
  trim(customer_name) as customer_name, upper(trim(country)) as country,
  upper(trim(customer_segment)) as customer_segment,
  coalesce(upper(trim(loyalty_tier)), 'NONE') as loyalty_tier,
  case when upper(trim(status)) in ('ACTIVE', 'INACTIVE', 'SUSPENDED', 'CHURNED')
    then upper(trim(status)) else 'UNKNOWN' end as status)
from deduplicated
"""

# Conditions on the original values; corrected values under their own names.
EVALUATED = r"""
select *,
  coalesce(regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'), false)
    as is_valid_email,
  total_revenue_cents < 0 as negative,
  greatest(total_revenue_cents, 0) as rev,
  churn_risk_score not between 0 and 100 as churn_off,
  case when churn_risk_score < 0 then 0 when churn_risk_score > 100 then 100
    else churn_risk_score end as churn,
  total_orders > 0 and 10 * abs(avg_order_value_cents * total_orders
    - greatest(total_revenue_cents, 0)) > greatest(total_revenue_cents, 0) as aov_off,
  case when total_orders > 0
    then (2 * greatest(total_revenue_cents, 0) * 10000 + total_orders) // (2 * total_orders)
    else 0 end as aov_micro,
  case currency when 'EUR' then 1080 when 'GBP' then 1270 when 'INR' then 12 else 1000 end as rate
from standardized
"""

SILVER = """
select customer_id, customer_name, email, country, customer_segment, loyalty_tier, status, currency,
  acquisition_channel, cast(total_orders as integer) as total_orders,
  cast(rev as double) / 100 as total_revenue_local,
  cast(aov_micro as double) / 1000000 as avg_order_value_local,
  cast(lifetime_value_cents as double) / 100 as lifetime_value_local,
  cast(churn as integer) as churn_risk_score, registration_date, first_purchase_date,
  last_purchase_date, last_updated_at, data_source_system,
  cast(rev * rate as double) / 100000 as total_revenue_usd,
  cast(aov_micro * rate as double) / 1000000000 as avg_order_value_usd,
  cast(lifetime_value_cents * rate as double) / 100000 as lifetime_value_usd,
  cast(date_diff('day', registration_date, date '2002-01-01') as integer) as customer_tenure_days,
  cast(date_diff('day', last_purchase_date, date '2002-01-01') as integer)
    as days_since_last_purchase,
  lifetime_value_cents * rate > 200000000 as is_high_value_customer,
  case when churn >= 67 then 'HIGH' when churn >= 34 then 'MEDIUM' else 'LOW' end
    as churn_risk_label,
  is_valid_email,
  coalesce(nullif(concat_ws('|',
    case when not is_valid_email then 'INVALID_EMAIL' end,
    case when negative then 'NEGATIVE_REVENUE_CORRECTED' end,
    case when churn_off then 'CHURN_SCORE_OUT_OF_RANGE_CLAMPED' end,
    case when aov_off then 'AOV_MISMATCH_RECALCULATED' end), ''), 'CLEAN') as data_quality_flags,
  rev * rate as rev_units, aov_micro * rate as aov_units, lifetime_value_cents * rate as ltv_units
from evaluated
"""

SCORED = """
select *, execution_points + runtime_points + data_loss_points + impact_points as risk_score,
  case when execution_points + runtime_points + data_loss_points + impact_points >= 999
    then 'BLOCKED'
  when execution_points + runtime_points + data_loss_points + impact_points >= 10 then 'HIGH_RISK'
  when execution_points + runtime_points + data_loss_points + impact_points >= 7 then 'MEDIUM_RISK'
  else 'LOW_RISK' end as risk_classification
from (
  select *,
    case risk_level when 'HIGH' then 3 when 'LOW' then 1 else 2 end as execution_points,
    case runtime_class when 'HIGH' then 3 when 'LOW' then 1 else 2 end as runtime_points,
    case data_loss_risk when 'HIGH' then 3 when 'LOW' then 1 else 2 end as data_loss_points,
    scope_size as impact_points
  from strategies)
"""

RANKED = """
select *, row_number() over (partition by incident_key
  order by risk_score, scope_size, strategy_key) as strategy_rank
from scored
"""

DECIDED = """
select a.incident_key, a.strategy_key as recommended_strategy_key, a.risk_score,
  a.risk_classification, a.data_loss_risk, a.scope_size,
  coalesce(b.risk_score - a.risk_score, 0) as margin,
  case when coalesce(b.risk_score - a.risk_score, 0) >= 3 then 'HIGH'
    when coalesce(b.risk_score - a.risk_score, 0) >= 1 then 'MEDIUM' else 'LOW' end as confidence
from ranked a left join ranked b on a.incident_key = b.incident_key and b.strategy_rank = 2
where a.strategy_rank = 1
"""

INPUTS = {
    "raw_customers": (RAW_CUSTOMERS, []),
    "deduplicated": (DEDUPLICATED, ["raw_customers"]),
    "standardized": (STANDARDIZED, ["deduplicated"]),
    "evaluated": (EVALUATED, ["standardized"]),
    "silver": (SILVER, ["evaluated"]),
    "incidents": (INCIDENTS, []),
    "strategies": (STRATEGIES, []),
    "scored": (SCORED, ["strategies"]),
    "ranked": (RANKED, ["scored"]),
    "decided": (DECIDED, ["ranked"]),
    "audit_events": (AUDIT_EVENTS, []),
    "lineage_edges": (LINEAGE_EDGES, []),
    "feed_tokens": (FEED_TOKENS, []),
    "orders_before": (ORDERS_BEFORE, []),
    "orders_after": (ORDERS_AFTER, []),
}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for item in [*_needed(INPUTS[name][1]), name]:
            if item not in out:
                out.append(item)
    return out


def over(names: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the common table expressions of the named inputs.

    A body that goes on with expressions of its own starts with a comma.
    """
    parts = [f"{n} as ({INPUTS[n][0].strip()})" for n in _needed(names.split())]
    return ("with " + ("recursive " if recursive else "") + ",\n".join(parts) + "\n" + body.strip())
