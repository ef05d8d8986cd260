"""Periodic runs of words, from Lyndon words.

A run is a longest stretch of words that repeats with a smallest period.  Every run
holds a Lyndon word of that period as a root, under an order of the words or under its
reverse.  The first phase of Baier's suffix sorter groups the suffixes by their longest
Lyndon prefix and so yields both Lyndon arrays directly, without sorting the rest; each
entry is a candidate root, extended to both sides by longest common extensions.

Only texts' repetitive stretches are sorted.  In a run of exponent four every word but
those of the last period has the same word again within a period, so a stretch of words
whose next occurrences are all no farther off than a third of its length is necessary;
the rest of a text, nearly all of ordinary prose, cannot hold a root.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.text import SPACES, id_and_text

EXPONENT = 4
LEAST = 6
# Rounds of narrowing stretches; fewer leave longer stretches, never too short ones.
ROUNDS = 8
SLICE = 2_000_000
RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place; a prefix counts as smaller.

    Groups of suffixes, each with a word that all its members start with, are taken from
    the highest down.  A group's word follows the words of the nearest earlier suffixes
    that are not done yet, so those grow by it, once for each member that follows them,
    and move to a group right above their old one.  A group's word is final when it is
    taken.  Members that have moved stay in their old list and are passed over.
    """
    n = len(codes)
    length, done, before = [1] * n, [False] * n, list(range(-1, n - 1))
    places: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(codes):
        places[c].append(i)
    members = [places[c] for c in sorted(places)]
    home = [0] * n
    for k, some in enumerate(members):
        for i in some:
            home[i] = k
    sizes, words, top = list(map(len, members)), [1] * len(members), len(members) - 1
    below, above = list(range(-1, top)), [*range(1, top + 1), -1]
    while top >= 0:
        taken, word = top, words[top]
        group = [i for i in members[taken] if home[i] == taken and not done[i]]
        members[taken] = []
        top = below[taken]
        if top >= 0:
            above[top] = -1
        for i in group:
            done[i], length[i] = True, word
        followed: dict[int, int] = {}
        for i in group:
            j = before[i]
            while j >= 0 and done[j]:
                before[i] = before[j]
                i, j = j, before[j]
            if j >= 0:
                followed[j] = followed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in followed.items():
            moves.setdefault((home[j], times), []).append(j)
        # Those followed more often are the higher ones; each goes right above the old group.
        for old, times in sorted(moves, reverse=True):
            some = moves[old, times]
            if len(some) == sizes[old]:
                words[old] += times * word
                continue
            new = len(members)
            members.append(some)
            sizes.append(len(some))
            words.append(words[old] + times * word)
            sizes[old] -= len(some)
            for j in some:
                home[j] = new
            over = above[old]
            below.append(old)
            above.append(over)
            above[old] = new
            if over >= 0:
                below[over] = new
            else:
                top = new
    return length


def _common(data: bytes, i: int, j: int, limit: int, back: bool = False) -> int:
    """How many words after (or before) places i and j are equal, by slices that double, then halve."""
    got, step, growing = 0, 4, True
    while got < limit:
        m = min(step, limit - got)
        a, b = (i - got - m, j - got - m) if back else (i + got, j + got)
        if data[4 * a:4 * (a + m)] == data[4 * b:4 * (b + m)]:
            got += m
        elif m == 1:
            break
        else:
            growing, step = False, m
        step = step * 2 if growing else max(step // 2, 1)
    return got


def _stretches(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the stretches of words that may hold a run of exponent four."""
    n = len(codes)
    order = np.argsort(codes.astype(np.uint16) if n and codes.max() < 65536 else codes, kind="stable")
    far = n + 1
    gap = np.full(n, far, np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    gap[np.arange(n) + gap >= np.repeat(np.cumsum(counts), counts)] = far
    alive, left = gap < far, -1
    for _ in range(ROUNDS):
        edges = np.flatnonzero(np.diff(np.r_[False, alive, False]))
        sizes = edges[1::2] - edges[::2]
        if alive.sum() == left:
            break
        left = alive.sum()
        at = np.flatnonzero(alive)
        wide = np.repeat(sizes, sizes)
        alive[at[(3 * gap[at] > wide) | (wide < LEAST - 1)]] = False
    edges = np.flatnonzero(np.diff(np.r_[False, alive, False]))
    return edges[::2], edges[1::2]


def runs_of(codes: list[int], data: bytes, low: int, high: int, stretches: list[tuple[int, int]]
            ) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one text, the words ``low`` to ``high`` of ``codes``."""
    found, last = set(), {}
    for start, stop in stretches:
        piece = codes[start:stop]
        arrays = lyndon_array(piece), lyndon_array([-c for c in piece])
        for i, roots in enumerate(zip(*arrays), start):
            for p in set(roots):
                if EXPONENT * p > high - low:
                    continue
                known = last.get(p)
                if known and i + p <= known:
                    continue
                right = _common(data, i, i + p, high - i - p)
                left = _common(data, i, i + p, i - low, back=True)
                if left + right >= p:
                    last[p] = i + p + right
                    length = left + p + right
                    if length >= max(LEAST, EXPONENT * p):
                        found.add((i - left - low, length, p))
    return sorted((s, n, p) for s, n, p in found)


def text_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, given as its words, by start, then period."""
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.fromiter(map(defaultdict(count().__next__).__getitem__, chain.from_iterable(texts)), np.int32,
                        int(counts.sum()))
    starts, stops = _stretches(codes, counts)
    ends = np.cumsum(counts)
    owner = np.searchsorted(ends, starts, side="right")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k in np.unique(owner).tolist():
        low, high = int(ends[k] - counts[k]), int(ends[k])
        own = codes[low:high]
        mine = owner == k
        out[k] = runs_of(own.tolist(), own.tobytes(), 0, high - low,
                         list(zip((starts[mine] - low).tolist(), (stops[mine] - low).tolist())))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the repeats of all runs, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period:start + length] = False
        words = list(compress(words, keep.tolist()))
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The periodic runs of every whole text, and the text without their repeats.

    Returns one row per row: doc_id, n_words, runs (start, length and period in words, by
    start, then period), collapsed (the words that no run holds after its first period,
    joined by one space).  A run is at least four periods and six words long, and no
    neighbouring word goes on with its period.  Null counts as empty and has no run; a
    row without an id is read like any other; repeated rows give repeated results; other
    columns are not read.
    """
    def found(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            low, size = 0, 0
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for k, n in enumerate(lengths, 1):
                size += n
                if size >= SLICE or k == len(lengths):
                    lists = [(t or b"").split() for t in texts.slice(low, k - low).to_pylist()]
                    runs = text_runs(lists)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(low, k - low), pa.array(list(map(len, lists)), pa.int64()),
                         pa.array([[dict(zip(("start", "length", "period"), r)) for r in some] for some in runs], RUNS),
                         pa.array([collapsed(w, r) for w, r in zip(lists, runs)], pa.binary()).cast(pa.string())],
                        names=["doc_id", "n_words", "runs", "collapsed"])
                    low, size = k, 0

    rows = id_and_text(docs, id_col, text_col)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")
                       ).mapInArrow(found, SCHEMA)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where one text in ten, by crc32 of its id, repeats a stretch of its words to its end.

    With h the checksum, g = h / 10, n words, a = g mod n and p = 1 + (n - a) / (3 + g mod
    8), the words from a on become the p words at a over and over.  The others stay as they are.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    trimmed = F.btrim("text", F.lit(SPACES))
    chosen = rows.withColumn("words", F.when((F.col("h") % 10 == 0) & (F.length(trimmed) > 0), F.split(
        trimmed, "[\\x20\\x09-\\x0D]+"))).withColumn("n", F.size("words"))
    whole = F.expr("h div 10")
    placed = chosen.withColumn("a", F.when(F.col("words").isNotNull(), whole % F.col("n")).cast("int")).withColumn(
        "p", (1 + F.call_function("div", F.col("n") - F.col("a"), 3 + whole % 8)).cast("int"))
    head, part = F.expr("slice(words, 1, a)"), F.expr("slice(words, a + 1, p)")
    tail = F.slice(F.flatten(F.array_repeat(part, F.expr("int((n - a + p - 1) div p)"))), F.lit(1), F.expr("n - a"))
    return placed.select("doc_id", F.coalesce(F.array_join(F.concat(head, tail), " "), "text").alias("text"))


def run_report(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests, from the rows of ``periodic_runs``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[
        r[x].cast("string") for x in ("start", "length", "period")]), F.lit("\n")))

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        digest(F.array_join(lines, "")).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
