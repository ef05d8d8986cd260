"""Near copies by SimHash tries within groups of common minima, verified by exact Jaccard.

``simhash`` finds fingerprints that differ in three bits, which are texts that are equal
but for some words.  Texts whose sets of five-word shingles have a Jaccard similarity of
0.8 differ in ten bits in the middle, and blocks of bits that leave room for that would
hold nearly everything.  Here the groups are other ones: texts that agree on one of
``BANDS`` bands of six least hash values (at the limit of similarity 998 pairs of 1,000
do).  Within each group the binary trie of 64-bit SimHash fingerprints is walked against
itself, pairs of nodes are dropped as soon as their bits differ more often than the error
budget allows, and the pairs of texts that are left are verified by their shingles.

The walk runs with a small budget first and a larger one then, and skips pairs of nodes
that hang together already, so a crowd of near copies costs about one verification each.
Groups that consist of the same texts are walked once.  A group too large for one task is
walked in random chunks, twice, which links a crowd to itself; then in pairs of chunks,
but for those within one cluster, which have nothing to add.  No group is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.components import components
from lakewarden.llm.fingerprints import SHINGLE, SIMILAR, shingles, signatures
from lakewarden.llm.simhash import BITS, STEP
from lakewarden.llm.text import id_and_text, in_slices, numbered, restored
from lakewarden.session import stored

BAND = 6
BANDS = 21
# A pair at the limit of similarity differs in 9.7 bits in the mean, in over 20 once in some thousands.
BUDGETS = (2, 8, 20)
# Shingles of a group that one task may hold.
LIMIT = 4_000_000
MEMBER = ["band", "value", "part", "class", "print", "label", "shingles"]


def _sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    values, counts = shingles(texts, SHINGLE)
    return [np.unique(values[end - n:end]) for n, end in zip(counts, np.cumsum(counts))]


def _class(shingle_set: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingle_set.tobytes()) - 2 ** 63


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set: a bit is set where over half of the elements' hashes have it; 0 if empty."""
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    out, full = np.zeros(len(sets), np.uint64), np.flatnonzero(counts)
    if not len(full):
        return out
    hashes = np.concatenate([sets[i] for i in full]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        hashes = (hashes ^ hashes >> np.uint64(shift)) * np.uint64(factor)
    hashes ^= hashes >> np.uint64(31)
    starts = np.cumsum(counts[full]) - counts[full]
    for bit in range(64):
        ones = np.add.reduceat(hashes >> np.uint64(bit) & np.uint64(1), starts)
        out[full] |= (ones * np.uint64(2) > counts[full].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class (a hash of the set of shingles), number of shingles, print and bands of every whole text."""
    def computed(batches):
        for ids, texts in in_slices(batches):
            sets = _sets(texts)
            bands = signatures(texts)[:, :BAND * BANDS].reshape(len(texts), BANDS, BAND)
            values = [[xxhash.xxh64_intdigest(b.tobytes()) - 2 ** 63 for b in row] for row in bands]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(_class, sets), pa.int64()),
                 pa.array(map(len, sets), pa.int64()), pa.array(set_prints(sets).view(np.int64), pa.int64()),
                 pa.array(values, pa.list_(pa.int64()))], names=["doc_id", "class", "size", "print", "bands"])

    return id_and_text(docs, id_col, text_col).filter("doc_id is not null").mapInArrow(
        computed, "doc_id long, class long, size long, print long, bands array<long>")


def _shingles_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """class and shingles of the wanted documents (doc_id, class), read again from their texts."""
    def computed(batches):
        for batch in batches:
            for pairs, texts in in_slices([pa.RecordBatch.from_arrays([batch.column(1), batch.column(2)], ["c", "t"])]):
                sets = _sets(texts)
                keep = [i for i, s in enumerate(sets) if _class(s) == pairs[i]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pairs[i] for i in keep], pa.int64()),
                     pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["class", "shingles"])

    rows = id_and_text(docs, id_col, text_col).join(wanted, "doc_id").select("doc_id", "class", "text")
    # An id that comes twice with one text gives its class twice.
    return rows.mapInArrow(computed, "class long, shingles binary").dropDuplicates(["class"])


def pairs_within(group: np.ndarray, prints: np.ndarray, label: np.ndarray, above: int, budget: int,
                 piece: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group whose prints differ in more than ``above`` and at most ``budget`` bits.

    Rows are sorted by (group, print), which may repeat.  Nodes of the tries whose rows
    all have one ``label`` are not opened against each other; the caller may change
    labels between pieces.
    """
    n = len(prints)
    keys = [group, *(prints >> np.uint64(64 - depth) for depth in range(STEP, 65, STEP)), np.arange(n)]
    opens, levels, tail = np.zeros(n, bool), [], []
    opens[0] = True
    for key in keys:
        opens = opens.copy()
        opens[1:] |= key[1:] != key[:-1]
        levels.append(np.flatnonzero(opens))
        # Groups and rows, the first and the last level, have no bits of their own.
        tail.append(key[levels[-1]].astype(np.int64) & (1 << STEP) - 1 if 1 < len(levels) < len(keys)
                    else np.zeros(len(levels[-1]), np.int64))
    first = [np.searchsorted(levels[k + 1], levels[k]) for k in range(len(levels) - 1)]
    count = [np.diff(np.r_[f, len(levels[k + 1])]) for k, f in enumerate(first)]
    low, high = ([f.reduceat(label, s) for s in levels] for f in (np.minimum, np.maximum))
    roots = np.flatnonzero(low[0] != high[0])
    stack = [(0, roots[i:i + piece], roots[i:i + piece], np.zeros(len(roots[i:i + piece]), np.int8))
             for i in range(0, len(roots), piece)]
    while stack:
        k, a, b, d = stack.pop()
        if k == len(levels) - 1:
            keep = (a < b) & (d > above)
            if keep.any():
                yield a[keep], b[keep]
                low, high = ([f.reduceat(label, s) for s in levels] for f in (np.minimum, np.maximum))
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
        far = d[owner] + BITS[tail[k + 1][x] ^ tail[k + 1][y]]
        same = (low[k + 1][x] == high[k + 1][x]) & (low[k + 1][x] == low[k + 1][y]) & (
            low[k + 1][y] == high[k + 1][y])
        keep = (far <= budget) & (x <= y) & ~same
        stack.append((k + 1, x[keep], y[keep], far[keep]))


def links_within(group: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], known: np.ndarray,
                 similar: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (group, print): row and least row of its group that it hangs together with.

    Rows of a group with an equal number in ``known`` hang together already, others by
    pairs of at least the similarity.  Only rows whose least row is another are returned.
    """
    n = len(prints)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    order = np.lexsort((label, known, group))
    opens = np.r_[True, (group[order][1:] != group[order][:-1]) | (known[order][1:] != known[order][:-1])]
    label[order] = order[np.maximum.accumulate(np.where(opens, np.arange(n), 0))]
    sizes = np.fromiter(map(len, sets), np.int64, n)

    def root(row: int) -> int:
        while label[row] != row:
            label[row] = label[label[row]]
            row = label[row]
        return row

    for above, budget in zip((-1, *BUDGETS), BUDGETS):
        for a, b in pairs_within(group, prints, label, above, budget):
            fits = (np.minimum(sizes[a], sizes[b]) >= similar * np.maximum(sizes[a], sizes[b])) & (label[a] != label[b])
            for x, y in zip(a[fits].tolist(), b[fits].tolist()):
                p, q = root(x), root(y)
                if p != q:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both >= similar * (sizes[x] + sizes[y] - both):
                        label[max(p, q)] = min(p, q)
            while (label[label] != label).any():
                label[:] = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _links(similar: float):
    """Links of whole groups; rows come sorted by band, value and part."""
    def linked(rows: list[np.ndarray], sets: list[bytes], new: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(new) - 1
        unsigned = rows[4].view(np.uint64)
        order = np.lexsort((unsigned, group))
        a, b = links_within(group[order], unsigned[order], [np.frombuffer(sets[i], np.uint32) for i in order],
                            rows[5][order], similar)
        names = rows[3][order]
        return pa.RecordBatch.from_arrays([pa.array(names[a], pa.int64()), pa.array(names[b], pa.int64())],
                                          names=["u", "v"])

    def walked(batches):
        rows, sets = [np.zeros(0, np.int64)] * 6, []
        for batch in batches:
            rows = [np.r_[r, np.asarray(c).astype(np.int64)] for r, c in zip(rows, batch.columns)]
            sets += batch.column(6).to_pylist()
            if not sets:
                continue
            new = np.r_[True, np.any([r[1:] != r[:-1] for r in rows[:3]], axis=0)]
            last = np.flatnonzero(new)[-1]
            if last:
                yield linked([r[:last] for r in rows], sets[:last], new[:last])
                rows, sets = [r[last:] for r in rows], sets[last:]
        if sets:
            yield linked(rows, sets, np.arange(len(sets)) == 0)

    return walked


def _walked(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Links (u, v) of classes, from members (band, value, part, class, print, label)."""
    rows = members.join(sets, "class").select(*MEMBER)
    return rows.repartition("band", "value", "part").sortWithinPartitions("band", "value", "part").mapInArrow(
        _links(similar), "u long, v long")


def _in_chunks(large: DataFrame, limit: int) -> DataFrame:
    """Members of large groups, with labels, once for each pair of chunks that holds unlinked pairs."""
    half, key = max(1, limit // 2), ["band", "value"]
    sizes = large.groupBy(*key, "label").agg(F.sum("size").alias("n"))
    own = stored(sizes.filter(F.col("n") > half).select(*key, "label", F.ceil(F.col("n") / half).alias("chunks")),
                 "near-clusters")
    rest = stored(sizes.filter(F.col("n") <= half).groupBy(*key).agg(F.ceil(F.sum("n") / half).alias("others")),
                  "near-rest")
    rows = large.join(own, [*key, "label"], "left").join(rest, key, "left").withColumn(
        "cluster", F.when(F.col("chunks").isNotNull(), F.col("label"))).withColumn(
        "chunk", F.when(F.col("chunks").isNotNull(), F.concat_ws(
            "-", "label", F.pmod(F.xxhash64("class"), F.col("chunks")))).otherwise(
            F.pmod(F.xxhash64("label"), F.col("others")).cast("string")))
    names = rows.select(*key, "cluster", "chunk").distinct()
    other = names.select(*key, F.col("cluster").alias("cluster2"), F.col("chunk").alias("chunk2"))
    pairs = stored(names.join(other, key).filter(
        (F.col("chunk") <= F.col("chunk2")) & ~F.coalesce(F.col("cluster") == F.col("cluster2"), F.lit(False))).select(
        *key, F.xxhash64("chunk", "chunk2").alias("part"),
        F.explode(F.array_distinct(F.array("chunk", "chunk2"))).alias("chunk")), "near-chunks")
    return rows.join(pairs, [*key, "chunk"]).select(*key, "part", "class", "print", "label")


def near_links(docs: DataFrame, rows: DataFrame, similar: float = SIMILAR, limit: int = LIMIT, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Links (u, v) between classes of ``rows`` (stored ``sketches``) that connect all near ones."""
    key = ["band", "value"]
    each = stored(rows.dropDuplicates(["class"]), "near-classes")
    spread = each.select("class", "doc_id", "size", "print", F.posexplode("bands").alias(*key))
    # Groups of the same texts, told by count, least name and exclusive or of the names, are walked once.
    groups = stored(spread.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min("class").alias("least"),
        F.bit_xor(F.xxhash64("class")).alias("names")).filter("n > 1").groupBy("n", "total", "least", "names").agg(
        F.min(F.struct(*key)).alias("k")).select("k.*", "total"), "near-groups")
    held = stored(spread.join(groups, key).select(*key, "total", "class", "doc_id", "size", "print"), "near-held")
    sets = stored(_shingles_of(docs, held.select("doc_id", "class").distinct(), id_col, text_col), "near-sets")
    plain = held.select(*key, "total", "size", F.lit(0).cast("long").alias("part"), "class", "print",
                        F.col("class").alias("label"))
    small, large = plain.filter(F.col("total") <= limit), plain.filter(F.col("total") > limit)
    links = _walked(small, sets, similar)
    if large.isEmpty():
        return links
    for seed in (1, 2):
        chunk = F.pmod(F.xxhash64("class", F.lit(seed)), F.ceil(2 * F.col("total") / limit))
        links = links.unionAll(_walked(large.withColumn("part", chunk), sets, similar))
    links = stored(links, "near-links")
    roots = components(links)
    labelled = large.drop("label", "part").join(roots, F.col("class") == F.col("node"), "left").withColumn(
        "label", F.coalesce("root", "class")).drop("node", "root")
    return links.unionAll(_walked(_in_chunks(stored(labelled, "near-labelled"), limit), sets, similar))


def near_copies(docs: DataFrame, similar: float = SIMILAR, limit: int = LIMIT, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the least id reachable over texts of at least the similarity.

    The similarity is that of the sets of five-word shingles, lower-cased in ASCII; a
    text of fewer words is one shingle, and texts without words (null, empty, white
    space) are near each other only.  One row for each row that has an id; repeated rows
    share their result; other columns are not read; an empty table gives an empty result.
    """
    rows = stored(sketches(docs, id_col, text_col), "near-sketches")
    roots = components(near_links(docs, rows, similar, limit, id_col, text_col))
    least = rows.groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = stored(least.join(roots, F.col("class") == F.col("node"), "left").select(
        "class", "least", F.coalesce("root", "class").alias("root")), "near-roots")
    names = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "near-names")
    named = stored(rooted.join(names, "root").select("class", "component_id"), "near-named")
    return rows.select("doc_id", "class").join(named, "class").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One document of each component, the one that names it, with all its columns.

    Ids are taken as keys; rows without an id stay, and stand for no others.
    """
    gone = near_copies(docs, similar, LIMIT, id_col, text_col).filter("doc_id <> component_id").select(
        F.col("doc_id").alias("__gone")).distinct()
    rows, number = numbered(docs, id_col)
    return restored(rows.join(gone, F.col(number).cast("long") == F.col("__gone"), "left_anti"), docs.columns)
