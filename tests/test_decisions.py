"""Lineage, impact, risk and decisions."""

import pytest
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.operators import lineage, risk


def graph(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "start string")


@pytest.mark.parametrize("edges,names,want", [
    ([], ["a"], [("a", "a", 0)]),
    ([("a", "a")], ["a"], [("a", "a", 0)]),
    ([("a", "b"), ("b", "a")], ["a"], [("a", "a", 0), ("a", "b", 1)]),
    ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d")], ["a"],
     [("a", "a", 0), ("a", "b", 1), ("a", "c", 1), ("a", "d", 1)]),
    ([("x", "y")], ["a"], [("a", "a", 0)]),
    ([("a", "b"), ("b", "c")], ["a", "b", "b"],
     [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1)]),
])
def test_reach(spark, rows, edges, names, want):
    out = lineage.reach(graph(spark, edges), starts(spark, *names))
    assert rows(out, "start", "node", "depth") == want


def test_visited_rows_do_not_move(spark, tmp_path):
    seen = spark.range(1000).selectExpr("id as start", "id * 7 as node", "1 as depth")
    for number in range(3):
        lineage.add_round(seen.withColumn("node", F.col("node") + number), "seen_before", str(tmp_path / "t"), 8, number)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = lineage.unvisited(seen.withColumn("node", F.col("node") + 2 * (F.col("start") % 2)), spark.table("seen_before"))
        assert left.count() == 0
        left = lineage.unvisited(seen.withColumn("node", F.col("node") + 5), spark.table("seen_before"))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 1000 and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 2 ** 20))
        spark.sql("drop table seen_before")


def test_edges_and_visited_rows_do_not_pass_the_driver(spark, rows, tmp_path):
    level = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 9, 0), (2, None, 0)], "start int, node int, depth int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (None, 5)], "src int, dst int")
    lineage.add_round(level.select("start", F.col("node") + 1, "depth").toDF("start", "node", "depth"), "seen_small", str(tmp_path / "t"), 8, 0)
    try:
        further, left = lineage.one_further(level, edges), lineage.unvisited(level, spark.table("seen_small"))
        reached = spark.table("seen_small").drop("round")
        catalogue = spark.createDataFrame([(2, "x"), (3, "y")], "asset int, asset_type string")
        own = spark.createDataFrame([(7, 1), (7, 2)], "incident_key int, asset int")
        joined = [lineage.blast_radius(reached, edges), lineage.incident_radius(own, reached), lineage.impact(reached, catalogue)]
        for df in (further, left, *joined):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert rows(further, "start", "node", "dst") == [(1, 1, 2), (1, 2, 3), (1, 2, 4)]
        assert rows(left, "start", "node") == [(1, 1), (2, 9), (2, None)]
    finally:
        spark.sql("drop table seen_small")


def test_incident_radius(spark, rows):
    reached = lineage.reach(graph(spark, [("a", "b"), ("b", "c"), ("x", "c"), ("c", "a")]), starts(spark, "a", "x"))
    assets = spark.createDataFrame([(1, "a"), (1, "x"), (1, "a"), (2, "x"), (3, "q")], "incident_key int, asset string")
    assert rows(lineage.incident_radius(assets, reached)) == [(1, 2, 3, 3), (2, 1, 3, 3)]
    assert spark.catalog.listTables() == []


def test_reach_to_a_depth(spark, rows):
    out = lineage.reach(graph(spark, [("a", "b"), ("b", "c")]), starts(spark, "a"), max_depth=1)
    assert rows(out, "node") == [("a",), ("b",)]


def test_customer_lineage_and_impact(spark, rows):
    edges = graph(spark, fixed.CUSTOMER_LINEAGE)
    reached = lineage.reach(edges, starts(spark, "silver.customers"))
    assert rows(lineage.blast_radius(reached, edges)) == [("silver.customers", 2, 2, 2)]
    catalogue = spark.createDataFrame(
        fixed.IMPACT_CATALOGUE[:1],
        "asset string, asset_type string, criticality string, impact_level string, reason string")
    assert rows(lineage.impact(reached, catalogue), "asset", "depth", "criticality") == [
        ("customer_gold_pipeline", 1, "HIGH"), ("gold.customer_summary", 2, None)]


def test_diamond_counts_dependencies_twice(spark, rows):
    edges = graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    reached = lineage.reach(edges, starts(spark, "a"))
    assert rows(lineage.blast_radius(reached, edges)) == [("a", 3, 2, 4)]


def test_templates_score(spark, rows):
    options = risk.templates(spark).withColumn("scope_size", F.size("scope").cast("bigint"))
    got = rows(risk.score(options), "strategy_id", "risk_score", "risk_classification")
    assert got == [("REC-001", 11, "HIGH_RISK"), ("REC-002", 8, "MEDIUM_RISK"),
                   ("REC-003", 11, "HIGH_RISK")]


@pytest.mark.parametrize("size,label", [
    (0, "LOW_RISK"), (3, "LOW_RISK"), (4, "MEDIUM_RISK"), (6, "MEDIUM_RISK"), (7, "HIGH_RISK"),
    (995, "HIGH_RISK"), (996, "BLOCKED")])
def test_class_bounds(spark, size, label):
    df = spark.createDataFrame([("LOW", "LOW", "LOW", size)],
                               "risk_level string, runtime_class string, data_loss_risk string, "
                               "scope_size bigint")
    assert risk.score(df).collect()[0].risk_classification == label


def test_weights(spark):
    df = spark.createDataFrame([("HIGH", "??", None, 3)], "risk_level string, runtime_class string, "
                               "data_loss_risk string, scope_size bigint")
    got = risk.score(df, {"execution": 2, "runtime": 1, "data_loss": 0, "impact_scope": 3}).collect()[0]
    assert got.risk_score == 6 + 2 + 0 + 9


def scored(spark, *records):
    return spark.createDataFrame(
        [(i, s, r, None if r is None else "X", "LOW", n) for i, s, r, n in records],
        "incident_key int, strategy_key int, risk_score bigint, risk_classification string, "
        "data_loss_risk string, scope_size bigint")


@pytest.mark.parametrize("records,best,margin,confidence", [
    ([(1, 5, 8, 1)], 5, 0, "LOW"),
    ([(1, 5, 8, 1), (1, 6, 9, 1)], 5, 1, "MEDIUM"),
    ([(1, 5, 8, 1), (1, 6, 11, 1)], 5, 3, "HIGH"),
    ([(1, 5, 8, 2), (1, 6, 8, 1)], 6, 0, "LOW"),
    ([(1, 6, 8, 1), (1, 5, 8, 1)], 5, 0, "LOW"),
    ([(1, 5, None, 1), (1, 6, 8, 9)], 6, 0, "LOW"),
    ([(1, 5, None, 1)], None, None, None),
])
def test_decision(spark, records, best, margin, confidence):
    got = risk.decide(scored(spark, *records)).collect()[0]
    assert (got.recommended_strategy_key, got.margin, got.confidence) == (best, margin, confidence)


def test_rank_is_total(spark, rows):
    data = [(1, s, s % 3, s % 2) for s in range(30)] + [(1, 99, None, 0), (2, 1, 5, 5)]
    got = rows(risk.rank(scored(spark, *data)), "incident_key", "strategy_rank",
               "strategy_key")
    order = sorted(data[:30], key=lambda r: (r[2], r[3], r[1]))
    assert sorted(got) == [(1, i + 1, r[1]) for i, r in enumerate(order)] + [(1, 31, 99), (2, 1, 1)]


def test_rejected_reasons(spark, rows):
    df = spark.createDataFrame(
        [(1, "A", 8, "M", "LOW", 2), (1, "B", 8, "M", "HIGH", 3), (1, "C", 11, "H", "LOW", 2),
         (1, "D", None, None, "LOW", 2)],
        "incident_key int, strategy_key string, risk_score bigint, risk_classification string, "
        "data_loss_risk string, scope_size bigint")
    got = rows(risk.rejected(df), "strategy_key", "recommended_strategy_key", "risk_score", "best_risk_score",
               F.array_join("reasons", ","))
    assert got == [("B", "A", 8, 8, "EQUAL_RISK,OTHER_DATA_LOSS,WIDER_SCOPE"), ("C", "A", 11, 8, "HIGHER_RISK"),
                   ("D", "A", None, 8, "UNRATED")]


def test_candidates_and_tradeoffs(spark, rows):
    incidents = spark.createDataFrame([(1,), (2,)], "incident_key int")
    options = risk.score(risk.candidates(incidents))
    assert options.count() == 6
    chosen = risk.tradeoffs(risk.decide(options, "incident_key", "strategy_id", ["scope"]))
    assert rows(chosen, "recommended_strategy_id", "margin", "confidence",
                F.array_join("not_rebuilt", ",")) \
        == [("REC-002", 3, "HIGH", "raw.customers,bronze.customers")] * 2


def test_incidents_are_dealt_out_before_their_candidates(spark, tmp_path):
    spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("incident_key")).coalesce(1).write.parquet(str(tmp_path / "t"))
    options = risk.score(risk.candidates(spark.read.parquet(str(tmp_path / "t"))))
    sizes = [r["count"] for r in options.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 12000 and max(sizes) < 3000


def test_decision_audit(spark, rows):
    known = scored(spark, (1, 5, 8, 1), (2, 5, 8, 1), (3, 5, 8, 1))
    decisions = spark.createDataFrame([(1, 5, 8), (2, 5, 9), (3, 7, 8), (4, None, None)],
                                      "incident_key int, recommended_strategy_key int, risk_score bigint")
    got = rows(risk.audit_decisions(decisions, known, known), "incident_key", "status", "reason")
    assert got == [(1, "COMPLETED", None), (2, "BLOCKED", "SCORE_DIFFERS"),
                   (3, "BLOCKED", "UNKNOWN_STRATEGY"), (4, "BLOCKED", "NO_DECISION")]


def test_decision_factors(spark):
    got = risk.factors(scored(spark, (1, 5, 8, 2), (1, 6, 9, 1), (1, 7, None, 1), (2, 5, None, 1)))
    assert [tuple(r)[:4] for r in got.collect()] == [(1, 5, 2, 8)]


def test_outcome_is_the_decision(spark, rows):
    df = scored(spark, (1, 5, 8, 2), (1, 6, 8, 1), (1, 4, 8, 1), (1, 7, None, 0), (2, 5, None, 1), (3, 9, 3, 1))
    got = rows(risk.outcome(df, {"n": F.count("risk_score")}))
    assert got == [(1, 4, 3), (2, None, 0), (3, 9, 1)]
    assert [r[:2] for r in got] == rows(risk.decide(df), "incident_key", "recommended_strategy_key")
