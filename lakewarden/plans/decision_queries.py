"""Queries on lineage, impact, risk and the choice of a recovery strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.operators import incidents, lineage, risk
from lakewarden.plans import inputs
from lakewarden.plans.oracle_inputs import over
from lakewarden.plans.shape import plain
from lakewarden.session import stored

INCIDENT, STRATEGY = "incident_key", "strategy_key"


# Lineage ----------------------------------------------------------------------

def _source(spark: SparkSession) -> DataFrame:
    return spark.range(1, 2).select(F.col("id").alias("start"))


def _all_starts(edges: DataFrame) -> DataFrame:
    """Every asset that feeds another one."""
    return edges.select(F.col("src").alias("start")).distinct()


def lineage_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = inputs.lineage_edges(spark, sf_dir)
    return lineage.reach(edges, _source(spark)).select("start", "node", "depth")


def lineage_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = inputs.lineage_edges(spark, sf_dir)
    return lineage.blast_radius(lineage.reach(edges, _source(spark)), edges)


def lineage_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blast radius of every asset that feeds another one."""
    edges = inputs.lineage_edges(spark, sf_dir)
    return lineage.blast_radius(lineage.reach(edges, _all_starts(edges)), edges)


def lineage_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies downstream of the parts of returned, urgent orders; each order is an incident."""
    urgent = inputs.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority") < "2").select(
        F.col("o_orderkey").alias(INCIDENT))
    parts = inputs.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias(INCIDENT), F.col("l_partkey").alias("asset"))
    assets = stored(parts.join(urgent, INCIDENT, "left_semi"), "assets")
    reached = lineage.reach(inputs.lineage_edges(spark, sf_dir), assets.select(F.col("asset").alias("start")))
    return lineage.incident_radius(assets, reached)


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the parts, as a catalogue."""
    part = inputs.table(spark, sf_dir, "part")
    level = (F.when(F.col("p_size") > 33, "HIGH").when(F.col("p_size") > 16, "MEDIUM")
             .otherwise("LOW"))
    return part.select(
        F.col("p_partkey").alias("asset"), F.col("p_type").alias("asset_type"),
        level.alias("criticality"))


def impact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = inputs.lineage_edges(spark, sf_dir)
    return lineage.impact(lineage.reach(edges, _source(spark)), _catalogue(spark, sf_dir))


# Risk -------------------------------------------------------------------------

def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.score(inputs.strategies(spark, sf_dir))


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select(
        INCIDENT, STRATEGY, "execution_points", "runtime_points", "data_loss_points",
        "impact_points", "risk_score", "risk_classification")


def risk_score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other weights and bounds, as classes with their number of strategies."""
    scored = risk.score(inputs.strategies(spark, sf_dir),
                        {"execution": 2, "runtime": 1, "data_loss": 3, "impact_scope": 1},
                        [("BLOCKED", 20), ("HIGH_RISK", 15), ("MEDIUM_RISK", 12)])
    return scored.groupBy("risk_classification").agg(
        F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("total_score"))


def decision_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.rank(_scored(spark, sf_dir)).select(
        INCIDENT, STRATEGY, "risk_score", "strategy_rank")


def decision_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommendation of each incident with margin and confidence."""
    return risk.decide(_scored(spark, sf_dir))


def decision_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(risk.rejected(_scored(spark, sf_dir)))


def decision_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.factors(_scored(spark, sf_dir))


def strategy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known strategies for every incident, scored."""
    rows = risk.candidates(inputs.incidents(spark, sf_dir).select(INCIDENT))
    rows = risk.critical_scope(risk.score(rows), [a for a, *_ in fixed.IMPACT_CATALOGUE])
    return plain(rows.select(INCIDENT, "strategy_id", "name", "scope", "risk_score",
                             "risk_classification", "business_critical_assets_in_scope"))


def decision_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What spoke for the choice among the known strategies, with the critical assets."""
    rows = risk.score(risk.candidates(inputs.incidents(spark, sf_dir).select(INCIDENT)))
    rows = risk.critical_scope(rows, [a for a, *_ in fixed.IMPACT_CATALOGUE])
    return plain(risk.factors(rows, strategy="strategy_id"))


def decision_tradeoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice among the known strategies, and what it leaves as it is."""
    rows = risk.score(risk.candidates(inputs.incidents(spark, sf_dir).select(INCIDENT)))
    chosen = risk.decide(rows, INCIDENT, "strategy_id", ["scope"])
    return plain(risk.tradeoffs(chosen).select(
        INCIDENT, "recommended_strategy_id", "risk_score", "margin", "confidence", "not_rebuilt"))


def _doubtful_decisions(decided: DataFrame) -> DataFrame:
    """Decisions of which some name another score or an unknown strategy."""
    k = F.col(INCIDENT)
    return decided.select(
        INCIDENT,
        F.when(k % 13 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("recommended_strategy_key"))
        .alias("recommended_strategy_key"),
        F.when(k % 11 == 0, F.col("risk_score") + 1).otherwise(F.col("risk_score"))
        .alias("risk_score"))


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return risk.audit_decisions(_doubtful_decisions(risk.decide(scored)),
                                inputs.strategies(spark, sf_dir), scored)


def decision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(spark, sf_dir)


def strategies_unrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strategies joined to risk rows, which unrated ones do not have, and the choice."""
    scored = _scored(spark, sf_dir)
    rated = scored.filter("risk_level <> 'UNRATED'").select(
        INCIDENT, STRATEGY, "risk_score", "risk_classification")
    joined = risk.with_risk(inputs.strategies(spark, sf_dir), rated, [INCIDENT, STRATEGY])
    return risk.decide(joined).select(INCIDENT, "recommended_strategy_key", "risk_score", "margin")


def workflow_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investigation, audited decision and preview of the chosen strategy together."""
    from lakewarden.plans.history_queries import investigated

    previews = inputs.strategies(spark, sf_dir).select(
        INCIDENT, STRATEGY,
        F.when(F.col("data_loss_risk") == "HIGH", "WARNING").otherwise("PASSED")
        .alias("preview_status"))
    return incidents.workflow_status(investigated(spark, sf_dir), _audited(spark, sf_dir), previews)


QUERIES = {
    "lineage_reach": lineage_reach,
    "lineage_depth": lineage_depth,
    "lineage_multi": lineage_multi,
    "lineage_incidents": lineage_incidents,
    "impact_report": impact_report,
    "risk_score": risk_score,
    "risk_score_weighted": risk_score_weighted,
    "decision_rank": decision_rank,
    "decision_confidence": decision_confidence,
    "decision_rejected": decision_rejected,
    "decision_factors": decision_factors,
    "decision_critical": decision_critical,
    "strategy_candidates": strategy_candidates,
    "decision_tradeoffs": decision_tradeoffs,
    "decision_audit": decision_audit,
    "strategies_unrated": strategies_unrated,
    "workflow_status": workflow_status,
}


# Oracles ----------------------------------------------------------------------

_REACH = """
, paths(start, node, d) as (
  select {start}, {start}, 0 from {source}
  union
  select p.start, e.dst, p.d + 1 from paths p join lineage_edges e on p.node = e.src
  where e.src <> e.dst),
reached as (select start, node, cast(min(d) as integer) as depth from paths group by start, node)
"""

_ONE = _REACH.format(start="s", source="(values (cast(1 as bigint))) t(s)")
_MANY = _REACH.format(start="src", source="(select distinct src from lineage_edges)")

_RADIUS = """
select r.start, count(*) filter (where depth > 0) as impacted,
  max(depth) as max_depth, cast(coalesce(sum(n), 0) as bigint) as listed
from reached r left join (select src, count(*) as n from lineage_edges group by src) o
  on o.src = r.node
group by r.start
"""

_TEMPLATES = """
, templates(strategy_id, name, scope, scope_size, risk_score, risk_classification) as (values
  ('REC-001', 'Full Rebuild',
   'bronze.customers,silver.customers,customer_gold_pipeline,gold.customer_summary',
   4, 11, 'HIGH_RISK'),
  ('REC-002', 'Targeted Rebuild',
   'silver.customers,customer_gold_pipeline,gold.customer_summary', 3, 8, 'MEDIUM_RISK'),
  ('REC-003', 'Rollback',
   'raw.customers,bronze.customers,silver.customers,customer_gold_pipeline,gold.customer_summary',
   5, 11, 'HIGH_RISK'))
"""

AUDIT = """
, doubtful as (
  select incident_key,
    case when incident_key % 13 = 0 then -1 else recommended_strategy_key end
      as recommended_strategy_key,
    case when incident_key % 11 = 0 then risk_score + 1 else risk_score end as risk_score
  from decided),
decision_audit as (
  select d.incident_key, d.recommended_strategy_key, d.risk_score,
    s.risk_score as evaluated_score,
    case when s.risk_score = d.risk_score then 'COMPLETED' else 'BLOCKED' end as status,
    case when s.risk_score is null then 'UNKNOWN_STRATEGY'
      when s.risk_score <> d.risk_score then 'SCORE_DIFFERS' end as reason
  from doubtful d left join scored s
    on s.incident_key = d.incident_key and s.strategy_key = d.recommended_strategy_key)
"""

INVESTIGATED = """
, audited as (
  select incident_key, error_type, expected_columns, actual_columns, unexpected_columns,
    missing_columns,
    case when actual_columns is null or expected_columns is null then 'INCOMPLETE_EVIDENCE'
    when list_sort([x for x in str_split(actual_columns, ',')
           if not list_contains(str_split(expected_columns, ','), x)])
         <> list_sort(case when unexpected_columns = '' then [] else
              str_split(unexpected_columns, ',') end)
      or list_sort([x for x in str_split(expected_columns, ',')
           if not list_contains(str_split(actual_columns, ','), x)])
         <> list_sort(case when missing_columns = '' then [] else
              str_split(missing_columns, ',') end)
      then 'CONFLICTING_EVIDENCE' end as reason
  from incidents),
investigated as (
  select incident_key,
    case when error_type = 'SCHEMA_DRIFT' then 'SCHEMA_CONTRACT_VIOLATION' else 'UNKNOWN' end
      as classification,
    case when reason is null then 'COMPLETED' else 'BLOCKED' end as investigation_status,
    case when reason is not null or error_type <> 'SCHEMA_DRIFT' then 'INSUFFICIENT_EVIDENCE'
      else 'HIGH' end as investigation_confidence,
    reason as investigation_reason,
    case when reason is null and error_type = 'SCHEMA_DRIFT' then 'SCHEMA_CONTRACT_VIOLATION' end as finding,
    unexpected_columns as reported_unexpected, missing_columns as reported_missing
  from audited)
"""

ORACLES = {
    "lineage_reach": over("lineage_edges", _ONE + "select * from reached", recursive=True),
    "lineage_depth": over("lineage_edges", _ONE + _RADIUS, recursive=True),
    "lineage_multi": over("lineage_edges", _MANY + _RADIUS, recursive=True),
    "lineage_incidents": over("lineage_edges", """
        , assets as (select distinct l_orderkey as incident_key, l_partkey as asset
          from lineitem join orders on o_orderkey = l_orderkey
          where l_returnflag = 'R' and o_orderpriority < '2')
        """ + _REACH.format(start="asset", source="(select distinct asset from assets)") + """
        , nodes as (
          select incident_key, node, max(depth) as far, count(*) filter (where depth = 0) as own
          from assets join reached on start = asset group by incident_key, node)
        select incident_key, cast(sum(own) as bigint) as n_assets,
          count(*) filter (where far > 0) as impacted, max(far) as max_depth
        from nodes group by incident_key""", recursive=True),
    "impact_report": over("lineage_edges", _ONE + """
        select start, node as asset, depth, p_type as asset_type,
          case when p_partkey is null then null when p_size > 33 then 'HIGH'
            when p_size > 16 then 'MEDIUM' else 'LOW' end as criticality
        from reached left join part on p_partkey = node
        where depth > 0""", recursive=True),
    "risk_score": over("scored", """
        select incident_key, strategy_key, execution_points, runtime_points, data_loss_points,
          impact_points, risk_score, risk_classification from scored"""),
    "risk_score_weighted": over("scored", """
        select case when s >= 20 then 'BLOCKED' when s >= 15 then 'HIGH_RISK'
            when s >= 12 then 'MEDIUM_RISK' else 'LOW_RISK' end as risk_classification,
          count(*) as n, cast(sum(s) as bigint) as total_score
        from (select 2 * execution_points + runtime_points + 3 * data_loss_points + impact_points
          as s from scored)
        group by 1"""),
    "decision_rank": over("ranked", """
        select incident_key, strategy_key, risk_score, strategy_rank from ranked"""),
    "decision_confidence": over("decided", "select * from decided"),
    "decision_rejected": over("ranked", """
        select r.incident_key, r.strategy_key, r.risk_score, r.risk_classification,
          r.data_loss_risk, r.scope_size, w.strategy_key as recommended_strategy_key,
          w.risk_score as best_risk_score, w.risk_classification as best_risk_classification,
          w.data_loss_risk as best_data_loss_risk, w.scope_size as best_scope_size,
          concat_ws(',', case when r.risk_score > w.risk_score then 'HIGHER_RISK' end,
            case when r.risk_score = w.risk_score then 'EQUAL_RISK' end,
            case when r.data_loss_risk <> w.data_loss_risk then 'OTHER_DATA_LOSS' end,
            case when r.scope_size > w.scope_size then 'WIDER_SCOPE' end) as reasons
        from ranked r join ranked w on w.incident_key = r.incident_key and w.strategy_rank = 1
        where r.strategy_rank > 1"""),
    "decision_factors": over("decided", """
        select d.incident_key, recommended_strategy_key, n as evaluated, risk_score,
          risk_classification, data_loss_risk, scope_size
        from decided d join (select incident_key, count(*) as n from strategies
          group by incident_key) s on s.incident_key = d.incident_key"""),
    "strategy_candidates": over("incidents", _TEMPLATES + """
        select incident_key, strategy_id, name, scope, cast(risk_score as bigint) as risk_score,
          risk_classification,
          'customer_gold_pipeline,gold.customer_summary' as business_critical_assets_in_scope
        from incidents, templates"""),
    "decision_critical": over("incidents", _TEMPLATES + """
        select incident_key, strategy_id as recommended_strategy_id, cast(n as bigint) as evaluated,
          cast(risk_score as bigint) as risk_score, risk_classification, 'LOW' as data_loss_risk,
          cast(scope_size as bigint) as scope_size,
          'customer_gold_pipeline,gold.customer_summary' as business_critical_assets_in_scope
        from incidents, (select *, count(*) over () as n from templates)
        where strategy_id = 'REC-002'"""),
    "decision_tradeoffs": over("incidents", """
        select incident_key, 'REC-002' as recommended_strategy_id, cast(8 as bigint) as risk_score,
          cast(3 as bigint) as margin, 'HIGH' as confidence,
          'raw.customers,bronze.customers' as not_rebuilt
        from incidents"""),
    "decision_audit": over("scored decided", AUDIT + "select * from decision_audit"),
    "strategies_unrated": over("scored", """
        , r as (
          select s.incident_key, s.strategy_key, s.scope_size,
            case when s.risk_level <> 'UNRATED' then s.risk_score end as risk
          from scored s),
        o as (select *, row_number() over (partition by incident_key
          order by risk nulls last, scope_size, strategy_key) as place from r)
        select a.incident_key, case when a.risk is not null then a.strategy_key end
            as recommended_strategy_key, a.risk as risk_score,
          case when a.risk is not null then coalesce(b.risk - a.risk, 0) end as margin
        from o a left join o b on b.incident_key = a.incident_key and b.place = 2
        where a.place = 1"""),
    "workflow_status": over("incidents scored decided", AUDIT + INVESTIGATED + """
        select i.incident_key, d.recommended_strategy_key as strategy_key, i.investigation_status,
          d.status as strategy_status,
          case when s.data_loss_risk = 'HIGH' then 'WARNING' when s.data_loss_risk is not null
            then 'PASSED' end as preview_status,
          case when i.investigation_status = 'COMPLETED' and d.status = 'COMPLETED'
            and s.data_loss_risk <> 'HIGH' then 'WAITING_FOR_HUMAN_APPROVAL' else 'BLOCKED' end
            as workflow_status,
          case when i.investigation_status = 'COMPLETED' and d.status = 'COMPLETED'
            and s.data_loss_risk <> 'HIGH' then 'APPROVE' else 'UNBLOCK' end as next_step
        from investigated i left join decision_audit d on d.incident_key = i.incident_key
        left join strategies s on s.incident_key = i.incident_key
          and s.strategy_key = d.recommended_strategy_key"""),
}
