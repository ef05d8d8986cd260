"""Helpers for texts: columns that stay in the JVM, and byte and word helpers inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters [\x20\x09-\x0D]; bytes.split() cuts at exactly these.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def whole(column: str) -> Column:
    """The text of a column, null as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def without_spaces(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, text)


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), SPACES[1:], text)
    return F.regexp_count(spaced, F.lit("[^ ]+")).cast("long")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def numbered(docs: DataFrame, *named: str) -> tuple:
    """The rows with columns ``c0``, ``c1``, ..., so that no name can clash, and the new names of some."""
    return (docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]), *[f"c{docs.columns.index(n)}" for n in named])


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Numbered columns under the names they had."""
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def fold(id_col: str, folds: int) -> Column:
    """The remainder of crc32 of the id as text; null without an id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def in_slices(batches: Iterable[pa.RecordBatch], budget: int = 8_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and whole texts (null as empty) of rows, cut after about ``budget`` characters.

    The first column is the id, the second the text.  A slice holds at least one
    row, so a text of any length is passed whole.
    """
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1]) + 64
            if size >= budget:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


class WordCodes(dict):
    """32-bit codes of words; remembers frequent ones up to a bound."""

    def __init__(self, bound: int = 400_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh32_intdigest(word)
        if len(self) < self.bound:
            self[word] = code
        return code
