"""MinHash fingerprints of word shingles, and near-duplicates by bands and verified Jaccard.

A fingerprint holds the least value of each of ``PERMUTATIONS`` universal hash
permutations over a text's shingles, computed for many texts at once in numpy.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.text import WordCodes, id_and_text, in_slices
from lakewarden.session import work_folder

PERMUTATIONS = 128
SHINGLE = 5
SIMILAR = 0.8
# Four values a band: a pair at the limit of similarity meets in none of 32 once in ten million.
BANDS = 32
EMPTY = np.uint16(0xFFFF)
# An odd factor that spreads the last bits of a minimum over its first ones.
SPREAD = np.uint32(2654435769)
_CODES = WordCodes()


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets: ``x -> a * x + b`` permutes the 32-bit numbers."""
    random = np.random.Generator(np.random.PCG64(20240229))
    return (random.integers(0, 2 ** 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1),
            random.integers(0, 2 ** 32, PERMUTATIONS, np.uint32))


FACTORS, OFFSETS = _coefficients()


def shingles(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all texts' ``k``-word shingles one after the other, and the count per text.

    Words are cut at ASCII white space and lower-cased in ASCII.  A text with fewer
    words is one shingle, a text without words has none.
    """
    codes, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").lower().split()
        if words:
            words += [b""] * (k - len(words))
            codes.append(np.fromiter(map(_CODES.__getitem__, words), np.uint32, len(words)))
            counts[i] = len(words) - k + 1
    if not codes:
        return np.zeros(0, np.uint32), counts
    stream = np.concatenate(codes).astype(np.uint64)
    mixed = np.zeros(len(stream) - k + 1, np.uint64)
    for j in range(k):
        mixed = (mixed ^ stream[j:len(stream) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    own = counts[counts > 0]
    first = np.cumsum(own + k - 1) - (own + k - 1)
    at = np.arange(own.sum()) + np.repeat(first - (np.cumsum(own) - own), own)
    return (mixed[at] >> np.uint64(32)).astype(np.uint32), counts


def signatures(texts: list[str]) -> np.ndarray:
    """One row of ``PERMUTATIONS`` 16-bit values per text; all ``EMPTY`` without words."""
    values, counts = shingles(texts)
    out = np.full((len(texts), PERMUTATIONS), EMPTY, np.uint16)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts[full])
    starts = ends - counts[full]
    low = 0
    while low < len(full):  # parts that stay in the processor's cache
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + 60_000)))
        part, edges = values[starts[low]:ends[high - 1]], starts[low:high] - starts[low]
        for k in range(PERMUTATIONS):
            least = np.minimum.reduceat(part * FACTORS[k] + OFFSETS[k], edges)
            # All 32 bits count: the minima of long texts differ in their last bits only.
            out[full[low:high], k] = least * SPREAD >> np.uint32(16)
        low = high
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values, the estimate of the Jaccard similarity; two empty texts are alike."""
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (binary, big-endian 16-bit values) of every whole text.

    Null counts as empty; repeated rows give repeated results; other columns are not
    read.
    """
    def computed(batches):
        for ids, texts in in_slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _binary(signatures(texts))],
                                             names=["doc_id", "fingerprint"])

    return id_and_text(docs, id_col, text_col).mapInArrow(computed, "doc_id long, fingerprint binary")


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype(">u2")], pa.binary())


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class (a hash of the set of shingles), bands and the shingles themselves."""
    def computed(batches):
        for ids, texts in in_slices(batches):
            values, counts = shingles(texts)
            ends = np.cumsum(counts)
            sets = [np.unique(values[b - n:b]) for n, b in zip(counts, ends)]
            rows = signatures(texts).reshape(len(texts), BANDS, -1)
            bands = [[xxhash.xxh64_intdigest(r.tobytes(), k) - 2 ** 63 for k, r in enumerate(row)] for row in rows]
            names = [xxhash.xxh64_intdigest(x.tobytes()) - 2 ** 63 for x in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array([x.astype(np.int64) for x in sets], pa.list_(pa.int64()))],
                names=["doc_id", "class", "bands", "shingles"])

    return id_and_text(docs, id_col, text_col).mapInArrow(
        computed, "doc_id long, class long, bands array<long>, shingles array<long>")


def search(docs: DataFrame, queried: Column | None = None, similar: float = SIMILAR, id_col: str = "doc_id",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents alike to those of a query set, by default the ids divisible by 100.

    Texts with equal shingles are one class.  Signature bands of queried classes are
    joined with those of all classes, and the Jaccard similarity of each pair that
    meets is computed from the shingles.  Returns the pairs of classes (query_class,
    class, jaccard) from ``similar`` up, each class with itself included, and the
    members (doc_id, class) of all classes; texts without words are one class.
    """
    folder = work_folder(docs.sparkSession, "minhash")
    classes(docs, id_col, text_col).write.parquet(folder)
    rows = docs.sparkSession.read.parquet(folder)
    queried = F.col("doc_id") % 100 == 0 if queried is None else queried
    asked = rows.filter(queried).select("class").distinct()
    each = rows.dropDuplicates(["class"]).select("class", "bands", "shingles")
    wanted = each.join(asked, "class", "left_semi")
    meeting = wanted.select(F.col("class").alias("query_class"), F.explode("bands").alias("band")).join(
        each.select("class", F.explode("bands").alias("band")), "band").select("query_class", "class").distinct()
    sets = each.select("class", "shingles")
    pairs = meeting.join(sets, "class").join(
        wanted.select(F.col("class").alias("query_class"), F.col("shingles").alias("asked")), "query_class")
    both = F.size(F.array_intersect("shingles", "asked"))
    either = F.size("shingles") + F.size("asked") - both
    jaccard = F.when(either == 0, F.lit(1.0)).otherwise(both / either)
    return (pairs.select("query_class", "class", jaccard.alias("jaccard")).filter(F.col("jaccard") >= similar),
            rows.select("doc_id", "class"))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to as many from the start of the next text."""
    m = len(text) // 4
    return text[:len(text) - m] + following[:m]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
          "near_edited double, near_next double")


def neighbour_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how near they and the next text's are.

    The next document is the next by id, after the last the first; without an id rows
    come first; rows that repeat an id follow each other by text.  The ids are cut into
    ranges at quantiles that are themselves ids; the first document of each range also
    goes to the range before it, so each range is worked through alone, in order and in
    batches.  Returns one row per row.  Null counts as empty; other columns are not
    read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stats = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("cuts"),
                     F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("without")).first()
    cuts = np.array(sorted({*(stats["cuts"] or [])} - {stats["least"]}), np.int64)
    first = None if stats["without"] else stats["least"]

    def ranged(batches):
        for batch in batches:
            ids = batch.column(0)
            missing = np.asarray(ids.is_null())
            values = np.asarray(ids.fill_null(np.iinfo(np.int64).min))
            place = np.searchsorted(cuts, values, side="right").astype(np.int32)
            opens = np.flatnonzero(np.isin(values, cuts) & ~missing)
            wraps = np.flatnonzero(missing if first is None else values == first)
            take = np.concatenate([np.arange(len(values)), opens, wraps])
            bucket = np.concatenate([place, place[opens] - 1, np.full(len(wraps), len(cuts), np.int32)])
            kind = np.repeat(np.array([0, 1, 2], np.int32), [len(values), len(opens), len(wraps)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), ids.take(pa.array(take)),
                 batch.column(1).fill_null("").take(pa.array(take))], names=["bucket", "kind", "doc_id", "text"])

    def compared(batches):
        held = None  # bucket, kind, id, text, signature of the last row so far
        for batch in batches:
            todo, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns[:4])):
                todo.append(row)
                size += len(row[3]) + 64
                if size >= 4_000_000:
                    out, held = _pairs(todo, held)
                    yield out
                    todo, size = [], 0
            if todo:
                out, held = _pairs(todo, held)
                yield out

    ranges = rows.mapInArrow(ranged, "bucket int, kind int, doc_id long, text string")
    # The rows behind a range come last: `kind` before the id.
    ordered = ranges.repartition(n // 4, "bucket").sortWithinPartitions("bucket", "kind", "doc_id", "text")
    return ordered.mapInArrow(compared, RESULT)


def _pairs(rows: list[tuple], held: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """Results for all rows but the last, which waits for the next batch."""
    own = signatures([r[3] for r in rows])
    full = [(*r, s) for r, s in zip(rows, own)]
    if held is not None:
        full.insert(0, held)
    pairs = [(a, b) for a, b in zip(full, full[1:]) if a[1] == 0 and a[0] == b[0]]
    new = [edited(a[3], b[3]) for a, b in pairs]
    mine = np.array([a[4] for a, _ in pairs], np.uint16).reshape(-1, PERMUTATIONS)
    following = np.array([b[4] for _, b in pairs], np.uint16).reshape(-1, PERMUTATIONS)
    changed = signatures(new)
    return pa.RecordBatch.from_arrays(
        [pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
         pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
         _binary(mine), _binary(changed), pa.array(likeness(mine, changed), pa.float64()),
         pa.array(likeness(mine, following), pa.float64())],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    ), full[-1]
