"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end; the stream is cut
into blocks of equal word counts.  Slot ``i`` of the schedule belongs to the source in
whose share of the cumulative weights the fraction of ``i`` times the golden ratio
falls, so every stretch of the schedule has the sources in proportion.  The k-th slot
of a source takes its k-th block, from the first block again after the last.  The last
slot of a source is cut to its quota, and the few slots by which the schedule may fall
short of a quota are added at its end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakewarden.llm.text import numbered, restored, whole, word_count
from lakewarden.session import work_folder

GOLDEN = (math.sqrt(5) - 1) / 2
CHUNK = 65_536


def cycle_weights(rank: int) -> float:
    """Weights 1, 2, 3, repeating."""
    return float(rank % 3 + 1)


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight; none above ``cap`` times its size, the excess reshared by weight."""
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        unit = rest / sum(weights[k] for k in sorted(open_))
        full = [k for k in sorted(open_) if weights[k] * unit > cap * sizes[k]]
        for k in full:
            out[k] = float(cap * sizes[k])
        if not full:
            for k in open_:
                out[k] = weights[k] * unit
            break
        open_ -= set(full)
        rest = max(0.0, total - sum(out[k] for k in range(len(sizes)) if k not in open_))
    return out


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Id, source and words of each row, written once to the shared folder: texts are read a single time."""
    spark = docs.sparkSession
    folder = work_folder(spark, "mixing")
    docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
                word_count(whole(text_col)).alias("size")).write.parquet(folder)
    return spark.read.parquet(folder)


def catalogue(sized: DataFrame, weight: Callable[[int], float], share: float, cap: float,
              max_sources: int) -> list[dict]:
    """Sources by code point, null last, with size, rows, weight and target.

    This list is the only thing that the driver holds; more than ``max_sources``
    sources raise.
    """
    got = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).limit(
        max_sources + 1).collect()
    if len(got) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    got.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes, weights = [r["size"] for r in got], [weight(k) for k in range(len(got))]
    goals = targets(sizes, weights, share * sum(sizes), cap)
    return [{"number": k, "source": r["source"], "source_size": r["size"], "rows": r["rows"], "target": t}
            for k, (r, t) in enumerate(zip(got, goals))]


def schedule(spark: SparkSession, sources: list[dict], block: int, cap: float) -> DataFrame:
    """The slots: slot, number (of the source), rank (within the source), block, words, part.

    ``words`` is what the slot takes from the start of its block, ``part`` whether that
    is less than the block has.  Ranks come from counts per chunk of the schedule, so
    no task holds a whole source.
    """
    sources = [s for s in sources if min(round(s["target"]), int(cap * s["source_size"])) > 0]
    quota = {s["number"]: min(round(s["target"]), int(cap * s["source_size"])) for s in sources}
    need = {s["number"]: _slots(quota[s["number"]], s["source_size"], block) for s in sources}
    wanted = sum(need.values())
    edges = [x / wanted for x in accumulate(need.values())]
    place = F.size(F.filter(F.array(*map(F.lit, edges[:-1])), lambda e: e <= F.col("id") * F.lit(GOLDEN) % 1.0)
                   ) if len(edges) > 1 else F.lit(0)
    dealt = spark.range(wanted).select(
        F.col("id").alias("slot"), F.element_at(F.array(*map(F.lit, need)), place + 1).alias("number"),
        F.floor(F.col("id") / CHUNK).alias("chunk"))
    counts = dealt.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("number", "chunk", (F.sum("n").over(
        Window.partitionBy("number").orderBy("chunk")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("number", "chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("own", own).join(before, ["number", "chunk"]).select(
        "slot", "number", (F.col("own") + F.col("before")).alias("rank"))
    have = {r["number"]: r["n"] for r in counts.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    added, end = [], wanted
    for k, n in need.items():
        if have.get(k, 0) < n:
            added.append((k, have.get(k, 0), n, end))
            end += n - have.get(k, 0)
    if added:
        more = spark.createDataFrame(added, "number int, have long, need long, at long").select(
            "number", "have", "at", F.explode(F.sequence("have", F.col("need") - 1)).alias("rank"))
        ranked = ranked.unionByName(more.select((F.col("at") + F.col("rank") - F.col("have")).alias("slot"),
                                                "number", "rank"))
    plan = spark.createDataFrame(
        [(s["number"], quota[s["number"]], s["source_size"], -(-s["source_size"] // block)) for s in sources],
        "number int, quota long, source_size long, blocks long")  # one row a source, which the catalogue bounds
    number = F.col("rank") % F.col("blocks")
    left = F.col("quota") - F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") - number * block
    full = F.least(F.lit(block), F.col("source_size") - number * block)
    return (ranked.join(F.broadcast(plan), "number").select(
        "slot", "number", "rank", number.alias("block"), F.least(left, full).alias("words"),
        (left < full).alias("part")).filter("words > 0"))


def _slots(quota: int, size: int, block: int) -> int:
    """Slots that a quota needs: whole laps over the source and the rest."""
    return 0 if not size else quota // size * -(-size // block) + -(-(quota % size) // block)


def laid_out(sized: DataFrame, sources: list[dict], seed: int, per_bucket: int) -> DataFrame:
    """Where each document begins in its source's shuffled stream.

    Documents are ordered by hash.  A source is cut into hash ranges of about
    ``per_bucket`` documents, ranges are added up first and documents within them.
    """
    spark = sized.sparkSession
    names = spark.createDataFrame(
        [(s["number"], s["source"], max(1, -(-s["rows"] // per_bucket)), s["source_size"], s["target"]) for s in sources],
        "number int, source string, buckets long, source_size long, target double")
    rows = sized.join(F.broadcast(names), sized["source"].eqNullSafe(names["source"])).drop(names["source"])
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    unit = (key.cast("double") / 2.0 ** 64 + 0.5)
    rows = rows.withColumns({"key": key, "bucket": F.least(F.floor(unit * F.col("buckets")), F.col("buckets") - 1)})
    totals = rows.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    before = totals.select("number", "bucket", (F.sum("n").over(
        Window.partitionBy("number").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("number", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    placed = rows.withColumns({
        "place": F.row_number().over(order),
        "inside": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")})
    return placed.join(before, ["number", "bucket"]).withColumn("start", F.col("before") + F.col("inside"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weight: Callable[[int], float] = cycle_weights, share: float = 1.0, cap: float = 3.0, block: int = 1024,
        seed: int = 42, per_bucket: int = 10_000, max_sources: int = 10_000) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns one row per row: doc_id, source, size (words), source_size, target (of the
    source), taken.  Null texts and texts without words have size 0 and take 0; the
    null source is a source of its own, the last.  At most one document a source is
    taken in part.  Repeated rows are laid out one after the other, each on its own;
    other columns are not read; an empty table gives an empty result.
    """
    sized = sizes(docs, id_col, text_col, source_col)
    sources = catalogue(sized, weight, share, cap, max_sources)
    rows = laid_out(sized, sources, seed, per_bucket)
    if not any(s["target"] >= 0.5 for s in sources):
        return rows.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    slots = schedule(docs.sparkSession, sources, block, cap)
    blocks = slots.groupBy("number", "block").agg(
        F.sum(F.when(F.col("part"), 0).otherwise(1)).alias("whole"),
        F.max(F.when(F.col("part"), F.col("words"))).alias("part_words"))
    end = F.col("start") + F.col("size")
    parts = rows.withColumn("block", F.explode(F.when(F.col("size") > 0, F.sequence(
        F.floor(F.col("start") / block), F.floor((end - 1) / block))).otherwise(F.array(F.lit(-1).cast("long")))))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(end - F.col("block") * block, F.lit(block))
    cut = F.greatest(F.least(high, F.coalesce("part_words", F.lit(0))) - low, F.lit(0))
    taken = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) * (high - low) + cut).otherwise(0)
    return (parts.join(blocks, ["number", "block"], "left").withColumn("words", taken)
            .groupBy("number", "bucket", "place")
            .agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"),
                 F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                 F.sum("words").cast("long").alias("taken"))
            .drop("number", "bucket", "place"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as the mix starts it.

    Documents without words are in no block and so not in the mix.  Rows that repeat an
    id share their takings.
    """
    taken = mix(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias("__id")).agg(
        F.ceil(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int").alias("__copies")).filter("__copies > 0")
    rows, number, text = numbered(docs, id_col, text_col)
    joined = rows.join(taken, F.col(number).eqNullSafe(F.col("__id")))
    return restored(joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).filter(
        word_count(whole(text)) > 0), docs.columns)
