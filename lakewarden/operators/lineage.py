"""Downstream reach over a lineage graph, and its business impact.

The joins are merge joins: edges, catalogue and reached rows all grow with the graph, and as
files or in a cache they are so small that Spark would long take them for a broadcast, which
passes the driver at its full size.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.session import stored, work_folder


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, hops: int = 3) -> DataFrame:
    """All nodes downstream of each start: ``start``, ``node`` and least ``depth``.

    ``edges`` has ``src`` and ``dst``; ``starts`` has ``start``.  A start is listed
    with depth 0; cycles and nodes reached twice are visited once.

    Breadth first, ``hops`` levels a round: the newest level is joined with the edges that
    many times, each node keeps its least depth, and nodes of earlier rounds are dropped;
    so a round may walk up to ``hops - 1`` steps past a node that was visited before.  Visited rows stand in a
    table that is bucketed by start and node: only the new rows of a round move, to
    where the visited ones are, however many those are.  The table lies in the shared
    folder, one partition a round, which ends the plan's growth, survives lost executors
    and lets Spark plan by the true size of the newest level.
    """
    spark = edges.sparkSession
    folder = work_folder(spark, "reach")
    name = f"reach_{folder[-32:]}"
    kind = dict(starts.dtypes)["start"]
    edges = edges.select("src", "dst").filter((F.col("src") != F.col("dst")) & F.col("dst").isNotNull()).persist()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    add = partial(add_round, name=name, folder=folder, buckets=buckets)
    add(starts.filter(F.col("start").isNotNull()).select("start").distinct()
        .select("start", F.col("start").alias("node"), F.lit(0).alias("depth")), number=0)
    depth = number = 0
    try:
        while max_depth is None or depth < max_depth:
            level = spark.table(name).filter((F.col("round") == number) & (F.col("depth") == depth)).drop("round")
            if level.isEmpty():
                break
            last = depth + hops if max_depth is None else min(depth + hops, max_depth)
            levels = []
            while depth < last:
                depth += 1
                level = one_further(level, edges).select(
                    "start", F.col("dst").cast(kind).alias("node"), F.lit(depth).alias("depth")).distinct()
                levels.append(level)
            least = reduce(DataFrame.unionAll, levels).groupBy("start", "node").agg(F.min("depth").alias("depth"))
            number += 1
            add(unvisited(least, spark.table(name)), number=number)
    finally:
        edges.unpersist()
        spark.sql(f"drop table if exists {name}")  # the name only; its files are the result
    return spark.read.schema(f"start {kind}, node {kind}, depth int").parquet(folder)


def add_round(rows: DataFrame, name: str, folder: str, buckets: int, number: int) -> None:
    """New rows become a partition of the visited ones, one file a bucket."""
    (rows.select("start", "node", "depth", F.lit(number).alias("round")).repartition(buckets, "start", "node")
     .write.mode("append").format("parquet").partitionBy("round").bucketBy(buckets, "start", "node")
     .option("path", folder).saveAsTable(name))


def one_further(level: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of a level with each edge out of their node."""
    return level.join(edges.hint("merge"), level["node"] == edges["src"])


def unvisited(rows: DataFrame, visited: DataFrame) -> DataFrame:
    """Rows of which the visited ones, where they lie in buckets, need not move, nor pass the driver."""
    return rows.join(visited.hint("merge"), ["start", "node"], "left_anti")


def blast_radius(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """Per start: distinct downstream nodes, true depth, and listed dependencies.

    ``listed`` counts every edge out of a visited node, so a node that two paths
    lead to counts twice.
    """
    fan_out = (edges.groupBy(F.col("src").alias("node"))
               .agg(F.count(F.lit(1)).alias("out_edges")))
    return (reached.join(stored(fan_out, "fan-out").hint("merge"), "node", "left").groupBy("start").agg(
        F.count_if(F.col("depth") > 0).alias("impacted"),
        F.max("depth").alias("max_depth"),
        F.coalesce(F.sum("out_edges"), F.lit(0).cast("bigint")).alias("listed")))


def incident_radius(assets: DataFrame, reached: DataFrame, incident: str = "incident_key") -> DataFrame:
    """Per incident: its assets, the distinct nodes downstream of any of them, and the depth.

    ``assets`` has the incident and its ``asset``; ``reached`` comes from ``reach`` with the
    assets as starts, so assets that several incidents share are walked from once.
    """
    own = assets.select(incident, "asset").distinct()
    rows = own.join(reached.select(F.col("start").alias("asset"), "node", "depth").hint("merge"), "asset")
    nodes = rows.groupBy(incident, "node").agg(F.max("depth").alias("far"), F.count_if(F.col("depth") == 0).alias("own"))
    return nodes.groupBy(incident).agg(
        F.sum("own").alias("n_assets"), F.count_if(F.col("far") > 0).alias("impacted"), F.max("far").alias("max_depth"))


def impact(reached: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Downstream assets with what the catalogue knows of them; unknown ones stay, with NULLs.

    ``catalogue`` has one row per ``asset``.
    """
    downstream = reached.filter("depth > 0").select("start", F.col("node").alias("asset"), "depth")
    return downstream.join(catalogue.hint("merge"), "asset", "left")
