"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.session import work_folder


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def components(edges: DataFrame) -> DataFrame:
    """The least node of each node's component: node, root; only nodes with an edge.

    ``edges`` has two columns of comparable values, in any order and number.  Each
    round points every node to the least of its neighbours and itself, doubles those
    pointers, and replaces the nodes of all edges by what they point to, until no edge
    between different nodes is left; long chains shrink by half a round or faster.
    Rounds are written to the shared folder, which cuts the lineage and lets lost
    executors be replaced.  Minima combine before the shuffle, so a node with very many
    neighbours does not gather them in one task.
    """
    folder = work_folder(edges.sparkSession, "components")
    a, b = edges.columns
    left = _edges(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    left = _stored(left, folder, "edges-0")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        n = len(steps)
        both = left.unionAll(left.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to"))
        least = _stored(least, folder, f"least-{n}")
        doubled = least.join(least.select(F.col("u").alias("to"), F.col("to").alias("further")), "to").select(
            "u", F.col("further").alias("to"))
        steps.append(_stored(doubled, folder, f"step-{n}"))
        moved = left.join(steps[-1].withColumnRenamed("to", "p"), "u").select("v", "p").join(
            steps[-1].select(F.col("u").alias("v"), F.col("to").alias("q")), "v").select("p", "q").toDF("u", "v")
        left = _stored(_edges(moved), folder, f"edges-{n + 1}")
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = steps[0].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in steps[1:]:
        out = out.join(step.select(F.col("u").alias("root"), F.col("to").alias("next")), "root", "left").select(
            "node", F.coalesce("next", "root").alias("root"))
    return _stored(out, folder, "roots")


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct pairs of different nodes, the larger first."""
    return pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
