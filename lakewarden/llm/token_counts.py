"""Token counts of a byte-pair vocabulary, by a two-tier look-up inside each map task.

Tier one is a broadcast table with the token counts of frequent pre-tokens, made
from a bounded sample of documents.  Tier two is a cache per Python worker: a
pre-token that the table lacks is encoded by the tokenizer's library once and
remembered up to a bound.  No pre-token is ever shuffled.

A pre-token here is a run without ASCII white space.  The vocabulary drops white
space and never joins across it, so the counts of the runs add up to the count of
the text; whatever lies inside a run (case, punctuation, special strings, other
spaces) is left to the library.
"""

from __future__ import annotations

import uuid
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lakewarden.llm.text import id_and_text, in_slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Lengths(dict):
    """Token counts of pre-tokens: the frequent ones, then a cache of misses up to a bound."""

    def __init__(self, path: str, frequent: dict[bytes, int], bound: int):
        super().__init__(frequent)
        self.tokenizer, self.bound = Tokenizer.from_file(path), len(frequent) + bound
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, run: bytes) -> int:
        n = len(self.tokenizer.encode(run.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids)
        if len(self) < self.bound and len(run) <= 256:
            self[run] = n
        return n

    def count(self, text: bytes) -> int:
        return sum(map(self.__getitem__, text.split()))


_WORKER: dict[str, Lengths] = {}


def _lengths(path: str, frequent: dict[bytes, int] | None, bound: int, key: str) -> Lengths:
    """One table per Python worker and job, so that misses are remembered across tasks."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Lengths(path, frequent or {}, bound)
    return _WORKER[key]


def frequent_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     sample_docs: int = 2_000, sample_chars: int = 50_000, entries: int = 30_000) -> dict[bytes, int]:
    """Token counts of the most frequent pre-tokens in a bounded sample.

    The sample is the ``sample_docs`` ids with the smallest hash among texts of up to
    ``sample_chars`` characters; it decides which counts are looked up where, never a
    count.  Runs longer than 64 bytes stay out, so the table has a fixed size bound.
    """
    rows = id_and_text(docs, id_col, text_col)
    key = F.xxhash64("doc_id")
    chosen = (rows.filter(F.length("text") <= sample_chars).select(key.alias("key")).distinct()
              .orderBy("key").limit(sample_docs))
    sample = (rows.withColumn("key", key).join(F.broadcast(chosen), "key")
              .filter(F.length("text") <= sample_chars).dropDuplicates(["key"]).select("doc_id", "text"))

    def counted(batches):
        counts = Counter()
        for _, texts in in_slices(batches):
            for t in texts:
                counts.update(t.encode("utf-8", "surrogatepass").split())
        top = [run for run, _ in counts.most_common(entries) if len(run) <= 64]
        lengths = Lengths(path, {}, 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(top, pa.binary()), pa.array([lengths[run] for run in top], pa.int32())], names=["run", "n"])

    got = sample.coalesce(1).mapInArrow(counted, "run binary, n int").collect()
    return {bytes(r["run"]): r["n"] for r in got}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, frequent: dict[bytes, int] | None = None,
                 id_col: str = "doc_id", text_col: str = "text", cache: int = 500_000) -> DataFrame:
    """Tokens of every whole text, as the library of the vocabulary at ``path`` counts them.

    Returns one row per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit
    (``n_tokens > limit``).  Null counts as empty, empty texts have 0 tokens; repeated
    rows give repeated results; other columns are not read.
    """
    if frequent is None:
        frequent = frequent_lengths(docs, path, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most `entries` runs of 64 bytes
    key = uuid.uuid4().hex

    def counted(batches):
        lengths = _lengths(path, shared.value, cache, key)
        for ids, texts in in_slices(batches):
            data = [t.encode("utf-8", "surrogatepass") for t in texts]
            n = pa.array([lengths.count(d) for d in data], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(list(map(len, data)), pa.int64()), n, pc.greater(n, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(counted, SCHEMA)
