"""SimHash near-duplicates: fingerprints within a few bits, by a self-join of binary tries.

Equal fingerprints are one.  Different ones that differ in at most three of 64 bits
agree on at least one of four 16-bit blocks, so each fingerprint goes to four groups,
named by block and value, and a group is a trie of its own.

Within a task all groups' tries are walked together, from the top bits down: a pair of
nodes is opened into the pairs of their children, and dropped as soon as their bits
differ more often than allowed.  The walk runs for one differing bit first, then two,
then three, and skips pairs of nodes that hang together already.  A task returns, for
each fingerprint of a group, one link to the least fingerprint that it hangs together
with, not all pairs.

A group that is too large for one task is a crowd of near fingerprints.  Those are first
linked at one differing bit, by grouping on the fingerprint without each bit in turn.
Then the group is cut into chunks, with the large clusters in chunks of their own, and
each pair of chunks is walked in a task, but for pairs within one cluster, which have
nothing to add.  No link is lost, and no group is cut short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.components import components
from lakewarden.llm.text import id_and_text, in_slices, numbered, restored
from lakewarden.session import work_folder

SEED = 42
WORDS = 3
DISTANCE = 3
BLOCKS = DISTANCE + 1
GROUP_LIMIT = 200_000
STEP = 4
BITS = np.array([bin(i).count("1") for i in range(1 << STEP)], np.int8)


def shingle_hashes(text: str, k: int = WORDS) -> np.ndarray:
    """XXH64 of each ``k``-word shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:].tolist())], np.uint64)


def simhashes(texts: list[str]) -> np.ndarray:
    """64-bit fingerprints: a bit is set where over half of the shingles' hashes have it; 0 without words."""
    hashes = [shingle_hashes(t) for t in texts]
    counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    low = 0
    while low < len(full):
        high, size = low, 0
        while high < len(full) and (high == low or size + counts[full[high]] <= 100_000):
            size += counts[full[high]]
            high += 1
        some = full[low:high]
        bits = np.unpackbits(np.concatenate([hashes[i] for i in some]).astype(">u8").view(np.uint8)).reshape(-1, 64)
        ends = np.cumsum(counts[some])
        ones = np.add.reduceat(bits, ends - counts[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(ones * 2 > counts[some][:, None], axis=1).view(">u8").ravel()
        low = high
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and 64-bit fingerprint (as a signed long) of every whole text; null counts as empty."""
    def computed(batches):
        for ids, texts in in_slices(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(simhashes(texts).view(np.int64), pa.int64())],
                names=["doc_id", "print"])

    return id_and_text(docs, id_col, text_col).mapInArrow(computed, "doc_id long, print long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _one_bit_links(prints: DataFrame) -> DataFrame:
    """Links between fingerprints that differ in one bit: they agree without that bit."""
    without = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.col("print").bitwiseAND(
        F.lit(_signed(~(1 << b) & (1 << 64) - 1))).alias("rest")) for b in range(64)]))
    pairs = prints.select("print", without.alias("k")).groupBy("k.bit", "k.rest").agg(
        F.min("print").alias("v"), F.max("print").alias("u"))
    return pairs.filter("u <> v").select("u", "v")


def _in_chunks(held: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """For large groups (mask, value, print): the one-bit links, and rows for each pair of chunks.

    The rows are (mask, value, part, print, label); a part has at most about ``limit``.
    """
    near = _one_bit_links(held.select("print").distinct())
    clusters = components(near)
    half = max(1, limit // 2)
    rows = held.join(clusters, F.col("print") == F.col("node"), "left").select(
        "mask", "value", "print", F.coalesce("root", "print").alias("label"))
    sizes = rows.groupBy("mask", "value", "label").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > half).select(
        "mask", "value", "label", F.ceil(F.col("n") / half).alias("chunks"))
    small = sizes.filter(F.col("n") <= half).groupBy("mask", "value").agg(
        F.ceil(F.sum("n") / half).alias("chunks"))
    chunked = rows.join(large, ["mask", "value", "label"], "left").join(
        small.withColumnRenamed("chunks", "others"), ["mask", "value"], "left").withColumn(
        "cluster", F.when(F.col("chunks").isNotNull(), F.col("label"))).withColumn(
        "chunk", F.when(F.col("chunks").isNotNull(), F.concat_ws(
            "-", "label", F.pmod(F.xxhash64("print"), F.col("chunks")))).otherwise(
            F.pmod(F.xxhash64("label"), F.col("others")).cast("string")))
    names = large.select("mask", "value", F.col("label").alias("cluster"), F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("chunks") - 1)).alias("k")).select(
        "mask", "value", "cluster", F.concat_ws("-", "cluster", "k").alias("chunk")).unionByName(
        small.select("mask", "value", F.lit(None).cast("long").alias("cluster"), F.explode(F.sequence(
            F.lit(0).cast("long"), F.col("chunks") - 1)).alias("k")).select(
            "mask", "value", "cluster", F.col("k").cast("string").alias("chunk")))
    other = names.select("mask", "value", F.col("cluster").alias("cluster2"), F.col("chunk").alias("chunk2"))
    pairs = names.join(other, ["mask", "value"]).filter(
        (F.col("chunk") <= F.col("chunk2")) & ~F.coalesce(F.col("cluster") == F.col("cluster2"), F.lit(False))).select(
        "mask", "value", F.xxhash64("chunk", "chunk2").alias("part"),
        F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("chunk"))
    return near, chunked.join(pairs, ["mask", "value", "chunk"]).select("mask", "value", "part", "print", "label")


def links_within(group: np.ndarray, prints: np.ndarray, known: np.ndarray | None = None, distance: int = DISTANCE,
                 piece: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (group, print): row and least row of its group that it hangs together with.

    ``group`` numbers the groups from 0; prints are unsigned and differ within a group;
    rows of a group with an equal number in ``known`` hang together already.  Only rows
    whose least row is another one are returned.
    """
    n = len(prints)
    label = np.arange(n)
    if known is not None and n:
        order = np.lexsort((label, known, group))
        opens = np.r_[True, (group[order][1:] != group[order][:-1]) | (known[order][1:] != known[order][:-1])]
        label[order] = order[np.maximum.accumulate(np.where(opens, np.arange(n), 0))]
    levels = [np.flatnonzero(np.r_[True, group[1:] != group[:-1]])] if n else []
    for depth in range(STEP, 65, STEP):
        top = prints >> np.uint64(64 - depth)
        levels.append(np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (top[1:] != top[:-1])]))
    if not n or len(levels[0]) == n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = [np.searchsorted(levels[k + 1], levels[k]) for k in range(len(levels) - 1)]
    count = [np.diff(np.r_[f, len(levels[k + 1])]) for k, f in enumerate(first)]
    tail = [((prints[s] >> np.uint64(64 - STEP * k)) & np.uint64((1 << STEP) - 1)).astype(np.int64)
            for k, s in enumerate(levels) if k]
    for budget in range(1, distance + 1):
        low = [np.minimum.reduceat(label, s) for s in levels]
        high = [np.maximum.reduceat(label, s) for s in levels]
        roots = np.flatnonzero((low[0] != high[0]))
        found = []
        stack = [(0, roots[k:k + piece], roots[k:k + piece], np.zeros(len(roots[k:k + piece]), np.int8))
                 for k in range(0, len(roots), piece)]
        while stack:
            k, a, b, d = stack.pop()
            if k == len(levels) - 1:
                found.append((levels[k][a], levels[k][b]))
                continue
            pairs = count[k][a] * count[k][b]
            if len(a) > 1 and pairs.sum() > 2 * piece:
                half = len(a) // 2
                stack += [(k, a[:half], b[:half], d[:half]), (k, a[half:], b[half:], d[half:])]
                continue
            owner = np.repeat(np.arange(len(a)), pairs)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            width = count[k][b][owner]
            x, y = first[k][a][owner] + nth // width, first[k][b][owner] + nth % width
            far = d[owner] + BITS[tail[k][x] ^ tail[k][y]]
            same = (low[k + 1][x] == high[k + 1][x]) & (low[k + 1][x] == low[k + 1][y]) & (
                low[k + 1][y] == high[k + 1][y])
            keep = (far <= budget) & (x <= y) & ~same
            stack.append((k + 1, x[keep], y[keep], far[keep]))
        if found:
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            label = _merged(label, a, b)
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least row of each component after the links a-b are added."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _links(batches):
    """Links of whole groups; rows (mask, value, part, print, label) come sorted by the first three."""
    held = None
    for batch in batches:
        rows = np.stack([np.asarray(c) for c in batch.columns])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        new = np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)]
        last = np.flatnonzero(new)[-1]
        if last:
            yield _linked(rows[:, :last], new[:last])
        held = rows[:, last:]
    if held is not None and held.shape[1]:
        yield _linked(held, np.arange(held.shape[1]) == 0)


def _linked(rows: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    group = np.cumsum(new) - 1
    unsigned = np.ascontiguousarray(rows[3]).view(np.uint64)
    order = np.lexsort((unsigned, group))
    signed, label = rows[3][order], rows[4][order]
    a, b = links_within(group[order], unsigned[order], None if (label == signed).all() else label)
    return pa.RecordBatch.from_arrays([pa.array(signed[a], pa.int64()), pa.array(signed[b], pa.int64())],
                                      names=["u", "v"])


def near_links(prints: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (u, v) between different fingerprints of a column ``print`` that connect all near ones."""
    spark, folder = prints.sparkSession, work_folder(prints.sparkSession, "simhash-groups")
    width = 64 // BLOCKS
    masks = [_signed((1 << width) - 1 << width * k) for k in range(BLOCKS)]
    grouped = prints.select("print").distinct().select(
        F.explode(F.array(*map(F.lit, masks))).alias("mask"), "print").select(
        "mask", F.col("print").bitwiseAND(F.col("mask")).alias("value"), "print")
    grouped.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(
        "mask", "value").write.parquet(f"{folder}/large")
    large = spark.read.parquet(f"{folder}/large")
    if large.isEmpty():
        return _walked(grouped)
    grouped.join(large, ["mask", "value"], "left_semi").write.parquet(f"{folder}/held")
    near, parts = _in_chunks(spark.read.parquet(f"{folder}/held"), limit)
    return _walked(grouped.join(large, ["mask", "value"], "left_anti")).unionAll(_walked(parts)).unionAll(near)


def _walked(rows: DataFrame) -> DataFrame:
    if "part" not in rows.columns:
        rows = rows.select("mask", "value", F.lit(0).cast("long").alias("part"), "print", F.col("print").alias("label"))
    return rows.repartition("mask", "value", "part").sortWithinPartitions("mask", "value", "part").mapInArrow(
        _links, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least id reachable over near fingerprints.

    Returns one row per row.  Texts without words (null, empty, white space) have the
    fingerprint zero and link like any other.  Rows without an id take part, but name
    no component; a component of only such rows has a null id.  Repeated rows share
    their result; other columns are not read; an empty table gives an empty result.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession, "simhash")
    fingerprints(docs, id_col, text_col).write.parquet(folder)
    rows = spark.read.parquet(folder)
    distinct = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(distinct))
    rooted = distinct.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(
        F.col("print").alias("__print"), "component_id")
    return rows.join(named, F.col("print") == F.col("__print")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one that names it, with all its columns.

    Ids are taken as keys; rows without an id stay, since nothing names them.
    """
    gone = near_duplicates(docs, id_col, text_col).filter("doc_id <> component_id").select(
        F.col("doc_id").alias("__gone")).distinct()
    rows, number = numbered(docs, id_col)
    return restored(rows.join(gone, F.col(number).cast("long") == F.col("__gone"), "left_anti"), docs.columns)
