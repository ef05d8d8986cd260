"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.text import whole, word_count
from lakewarden.session import work_folder

LENGTHS = (512, 1024, 2048, 4096)
SHARD = 20_000
SCHEMA = "doc_id long, piece int, start long, length int, bin_id string, bin_length int, bin_offset int"


def sequence_cost(length: int) -> float:
    """What a sequence costs: its length and a fixed part for each sequence."""
    return length + 32.0


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS,
             cost: Callable[[int], float] = sequence_cost) -> tuple[list[tuple[int, int]], list[int]]:
    """Pack sizes, none above the longest length: (bin, offset) of each, and the bins' lengths.

    Sizes are placed from large to small, each into the fullest open bin that takes it.
    Where none does, a bin opens with the length that an opening table has for the class
    of the size, which is the least length that holds it.  At last each bin gets the
    least permitted length for its contents.  The table is chosen for all lengths
    jointly: of the tables that open one length wherever it fits the cheapest is taken,
    by the cost of the whole packing after bins are cut down, and then changed class by
    class as long as that gets cheaper.
    """
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    falling = [sizes[k] for k in order]
    tried: dict[tuple[int, ...], float] = {}

    def priced(table: tuple[int, ...]) -> float:
        if table not in tried:
            filled = Counter(_filled(falling, lengths, table)[1])
            tried[table] = sum(n * cost(lengths[bisect_left(lengths, used)]) for used, n in filled.items())
        return tried[table]

    table = min((tuple(max(x, own) for own in lengths) for x in reversed(lengths)), key=priced)
    better = True
    while better:
        better = False
        for k in range(len(lengths)):
            for other in lengths[k:]:
                changed = (*table[:k], other, *table[k + 1:])
                if priced(changed) < priced(table):
                    table, better = changed, True
    placed, used = _filled(falling, lengths, table)
    back = dict(zip(order, placed))
    return [back[k] for k in range(len(sizes))], [lengths[bisect_left(lengths, u)] for u in used]


def _filled(falling: Sequence[int], lengths: list[int], table: tuple[int, ...]) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of sizes from large to small, and how much each bin holds, by an opening table."""
    room: list[int] = []                 # distinct amounts of free room, sorted
    open_: dict[int, list[int]] = {}     # bins by free room
    used: list[int] = []
    placed = []
    for size in falling:
        at = bisect_left(room, size)
        if at < len(room):
            left = room[at]
            number = open_[left].pop()
            if not open_[left]:
                del open_[left]
                room.pop(at)
        else:
            left = table[bisect_left(lengths, size)]
            number = len(used)
            used.append(0)
        placed.append((number, used[number]))
        used[number] += size
        left -= size
        if left:
            if left not in open_:
                insort(room, left)
                open_[left] = []
            open_[left].append(number)
    return placed, used


def _pieces(doc_id: int | None, size: int, longest: int) -> Iterator[tuple[int | None, int, int, int]]:
    """A document in pieces of the longest length and a rest; without words one empty piece."""
    for n in range(max(1, -(-size // longest))):
        yield doc_id, n, n * longest, min(longest, size - n * longest)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS,
         cost: Callable[[int], float] = sequence_cost, shard: int = SHARD) -> DataFrame:
    """Where every document's words go: one row per piece.

    Returns doc_id, piece (from 0), start (first word), length (words), bin_id,
    bin_length (one of ``lengths``), bin_offset.  A document longer than the longest
    length is cut into pieces.  Documents are dealt by a hash into shards of about
    ``shard`` documents, and each is packed for itself in blocks of at most ``shard``
    documents, so memory is bounded however often an id repeats.  Null texts and texts
    without words give one row of length 0 without a bin.  Repeated rows are packed
    each; other columns are not read; an empty table gives an empty result.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession, "packing")
    docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), word_count(whole(text_col)).alias("size")
                ).write.parquet(folder)
    sized = spark.read.parquet(folder)
    shards = max(1, -(-sized.count() // shard))
    longest = max(lengths)

    def packed(batches):
        block, number, old = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if block and (row[0] != old or len(block) >= shard):
                    yield _packed(block, f"{old}-{number}", lengths, cost, longest)
                    number = 0 if row[0] != old else number + 1
                    block = []
                old = row[0]
                block.append(row[1:])
        if block:
            yield _packed(block, f"{old}-{number}", lengths, cost, longest)

    dealt = sized.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "doc_id", "size")
    return dealt.repartition("shard").sortWithinPartitions(
        "shard", F.xxhash64("doc_id", F.lit(1)), "doc_id", "size").mapInArrow(packed, SCHEMA)


def _packed(block: list[tuple], name: str, lengths: Sequence[int], cost: Callable[[int], float],
            longest: int) -> pa.RecordBatch:
    pieces = [p for doc_id, size in block for p in _pieces(doc_id, size, longest)]
    full = [k for k, p in enumerate(pieces) if p[3]]
    placed, sizes = best_fit([pieces[k][3] for k in full], lengths, cost)
    where: list[tuple] = [(None, None, None)] * len(pieces)
    for k, (number, offset) in zip(full, placed):
        where[k] = (f"{name}-{number}", sizes[number], offset)
    columns = list(zip(*(p + w for p, w in zip(pieces, where)))) or [()] * 7
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
    names = ["doc_id", "piece", "start", "length", "bin_id", "bin_length", "bin_offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)
