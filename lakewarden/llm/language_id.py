"""Language identification with interpolated Kneser-Ney character models.

One model per language, learned from a bounded sample of labelled rows.  The
n-grams of all languages stand together in sorted arrays of 64-bit hashes with
one log-probability per language beside each, so a character costs one look-up
in most cases, whatever the number of languages.  A document gets the language
with the lowest cross-entropy per character.  On a part of the sample that the
models have not seen, a temperature turns entropies into a score, and a limit
per language marks documents that look like none of them (``rejected``).
"""

from __future__ import annotations

import io
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.llm.text import id_and_text, in_slices

ORDER = 4
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, cross_entropy double, margin double, rejected boolean"


@dataclass
class Bounds:
    """What the sample may hold; the model is no larger than the sample allows."""

    docs_per_language: int = 800
    characters_per_language: int = 1_500_000
    languages: int = 256
    model_bytes: int = 256_000_000


@cache
def _letters() -> np.ndarray:
    """Every code point's lower-case letter, or 32 where it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters with single spaces between words, behind ``ORDER - 1`` zeros per text.

    Returns the stream, where each text's characters start in it and how many there are.
    """
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    points = _letters()[raw]
    space = points == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[first[lengths > 0]] = True
    text_of = np.repeat(np.arange(len(texts)), lengths)[keep]
    points = points[keep]
    counts = np.bincount(text_of, minlength=len(texts))
    pad = ORDER - 1
    out = np.zeros(len(points) + pad * len(texts), np.uint64)
    out[np.arange(len(points)) + pad * (text_of + 1)] = points
    starts = np.cumsum(counts) - counts + pad * (np.arange(len(texts)) + 1)
    return out, starts, counts


def _hashes(stream: np.ndarray) -> list[np.ndarray]:
    """For each order the hash of the n-gram that ends at a position; order 0 first."""
    single = _mix(stream + np.uint64(0x51ED270B))
    out = [np.zeros(len(stream), np.uint64), single]
    for n in range(2, ORDER + 1):
        older = np.zeros_like(single)
        older[n - 1:] = single[:-(n - 1)]
        out.append(_mix(out[-1] + older * np.uint64(2 * n + 0x2545F4914F6CDD1D)))
    return out


def _positions(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of all texts' own characters."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class HashTable:
    """Sorted hashes with an index by their leading bits; finds many at once."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.bits = np.uint64(64 - max(4, int(len(hashes) * 4).bit_length()))
        edges = np.arange((1 << (64 - int(self.bits))) + 1, dtype=np.uint64)
        self.first = np.searchsorted(self.hashes >> self.bits, edges).astype(np.int32)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(wanted), -1, np.int32)
        slot = (wanted >> self.bits).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        last = len(self.hashes) - 1
        found = np.where((at < end) & (self.hashes[np.minimum(at, last)] == wanted), at, -1)
        open_ = np.flatnonzero((found < 0) & (at + 1 < end))
        while len(open_):
            at[open_] += 1
            hit = self.hashes[at[open_]] == wanted[open_]
            found[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            open_ = open_[at[open_] + 1 < end[open_]]
        return found


def _distinct(hashes: list[np.ndarray], at: np.ndarray, n: int):
    """Distinct n-grams: hash, count, hash of the n-1 last characters, hash of the n-1 first."""
    own = hashes[n][at]
    grams, index, counts = np.unique(own, return_index=True, return_counts=True)
    where = at[index]
    return grams, counts, hashes[n - 1][where], hashes[n - 1][where - 1]


def fit_language(texts: list[str]) -> dict[str, np.ndarray]:
    """The Kneser-Ney counts of one language.

    For each order: the n-grams, the seen part of their probability, the hash of
    their shorter form, and for each context the weight that goes to the shorter
    form.  Orders below the highest count the distinct characters in front.
    """
    stream, starts, counts = _characters(texts)
    at = _positions(starts, counts)
    hashes = _hashes(stream)
    out: dict[str, np.ndarray] = {}
    tables = {n: _distinct(hashes, at, n) for n in range(1, ORDER + 1)}
    for n in range(1, ORDER + 1):
        grams, count, shorter, context = tables[n]
        if n < ORDER:
            longer = np.searchsorted(grams, tables[n + 1][2])
            count = np.bincount(longer, minlength=len(grams))
        count = count.astype(np.float64)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        contexts, place = np.unique(context, return_inverse=True)
        total = np.bincount(place, weights=count)
        kinds = np.bincount(place, weights=count > 0)
        out |= {f"grams{n}": grams, f"shorter{n}": shorter, f"context_of{n}": context, f"contexts{n}": contexts,
                f"seen{n}": np.maximum(count - discount, 0) / np.maximum(total, 1)[place],
                f"rest{n}": discount * np.maximum(kinds, 1) / np.maximum(total, 1)}
    return out


class Model:
    """All languages' models in common hash tables, and how to read the entropies."""

    def __init__(self, languages: list[str], fitted: list[dict[str, np.ndarray]]):
        self.languages = languages
        self.temperature, self.limits = 1.0, np.full(len(languages), np.inf)
        self.tables: list[HashTable | None] = [None]
        self.rests: list[HashTable | None] = [None]
        size = len(languages)
        if not size:
            return
        alphabet = len(np.unique(np.concatenate([m["grams1"] for m in fitted]))) + 1
        lower = None
        for n in range(1, ORDER + 1):
            contexts = np.unique(np.concatenate([m[f"contexts{n}"] for m in fitted]))
            rest = np.ones((len(contexts), size))
            grams = np.unique(np.concatenate([m[f"grams{n}"] for m in fitted]))
            shorter, context = np.zeros((2, len(grams)), np.uint64)
            p = np.zeros((len(grams), size))
            for k, m in enumerate(fitted):
                rest[np.searchsorted(contexts, m[f"contexts{n}"]), k] = m[f"rest{n}"]
                place = np.searchsorted(grams, m[f"grams{n}"])
                p[place, k] = m[f"seen{n}"]
                shorter[place], context[place] = m[f"shorter{n}"], m[f"context_of{n}"]
            back = np.full((len(grams), size), 1 / alphabet) if n == 1 else np.exp(lower.values[lower.find(shorter)])
            p += rest[np.searchsorted(contexts, context)] * back
            if n == 1:
                self.unseen = np.log(rest[0] / alphabet)
            lower = HashTable(grams, np.log(p).astype(np.float32))
            self.tables.append(lower)
            self.rests.append(HashTable(contexts, np.log(rest).astype(np.float32)))

    def size(self) -> int:
        return sum(t.hashes.nbytes + t.values.nbytes + t.first.nbytes for t in self.tables[1:] + self.rests[1:])

    def _log_p(self, hashes: list[np.ndarray], at: np.ndarray, n: int) -> np.ndarray:
        if n == 0:
            return np.broadcast_to(self.unseen, (len(at), len(self.languages))).astype(np.float32)
        row = self.tables[n].find(hashes[n][at])
        out = self.tables[n].values[np.maximum(row, 0)]
        missing = np.flatnonzero(row < 0)
        if len(missing):
            lower = self._log_p(hashes, at[missing], n - 1)
            if n > 1:
                rest = self.rests[n].find(hashes[n - 1][at[missing] - 1])
                lower = lower + np.where((rest >= 0)[:, None], self.rests[n].values[np.maximum(rest, 0)], 0)
            out[missing] = lower
        return out

    def entropies(self, texts: list[str], piece: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character for each text and language; which texts have letters."""
        stream, starts, counts = _characters(texts)
        has = np.zeros(len(texts), bool)
        at = _positions(starts, counts)
        text_of = np.repeat(np.arange(len(texts)), counts)
        has[text_of[stream[at] != 32]] = True
        hashes = _hashes(stream)
        sums = np.zeros((len(texts), len(self.languages)))
        for k in range(0, len(at), piece):
            part, owner = at[k:k + piece], text_of[k:k + piece]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sums[owner[first]] += np.add.reduceat(self._log_p(hashes, part, ORDER), first, axis=0, dtype=np.float64)
        return -sums / np.maximum(counts, 1)[:, None], has

    def calibrate(self, texts: list[str], languages: list[str]) -> None:
        """Temperature of the score and the rejection limits, from texts outside the fit."""
        if not texts:
            return
        entropy, has = self.entropies(texts)
        truth = np.array([self.languages.index(x) for x in languages], int)
        entropy, truth = entropy[has], truth[has]
        if not len(truth):
            return

        def loss(t: float) -> float:
            z = -entropy * t
            z -= z.max(1, keepdims=True)
            return -np.mean(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(1)))

        self.temperature = float(min(2.0 ** np.arange(-1, 7, 0.5), key=loss))
        for k in range(len(self.languages)):
            own = entropy[truth == k, k]
            if len(own) >= 20:
                self.limits[k] = np.quantile(own, 0.99) + 3 * own.std() + 0.05

    def predict(self, texts: list[str]) -> tuple[list, list, list, list, list]:
        if not self.languages:
            n = len(texts)
            return [UNKNOWN] * n, [0.0] * n, [None] * n, [None] * n, [True] * n
        entropy, has = self.entropies(texts)
        best = entropy.argmin(1)
        low = entropy[np.arange(len(best)), best]
        z = np.exp(-(entropy - low[:, None]) * self.temperature)
        score = np.where(has, 1 / z.sum(1), 0.0)
        if len(self.languages) > 1:
            margin = np.partition(entropy, 1, axis=1)[:, 1] - low
        else:
            margin = np.zeros(len(low))
        rejected = ~has | (low > self.limits[best])
        names = [self.languages[k] if h else UNKNOWN for k, h in zip(best, has)]
        hidden = lambda v: [float(x) if h else None for x, h in zip(v, has)]
        return names, score.tolist(), hidden(low), hidden(margin), rejected.tolist()


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, bounds: Bounds) -> DataFrame:
    """Distinct labelled texts within the bounds, chosen by their hash.

    The choice runs over hashes and lengths only; texts of ordinary length come first.
    """
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    keyed = rows.withColumn("key", F.xxhash64("text"))
    narrow = keyed.groupBy("lang", "key").agg(F.max(F.length("text")).alias("n"))
    many = Window.partitionBy("lang").orderBy(F.col("n") > 100_000, "key")
    few = narrow.withColumn("rank", F.row_number().over(many)).filter(F.col("rank") <= bounds.docs_per_language)
    filled = F.sum("n").over(many.rowsBetween(Window.unboundedPreceding, 0))
    chosen = few.withColumn("filled", filled).filter(
        (F.col("filled") <= bounds.characters_per_language) | (F.col("rank") == 1)).select("lang", "key")
    picked = keyed.join(F.broadcast(chosen), ["lang", "key"])  # at most docs_per_language * languages rows
    return picked.dropDuplicates(["lang", "key"])


def _pack(table: dict[str, np.ndarray]) -> bytes:
    np.savez(out := io.BytesIO(), **table)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as table:
        return dict(table)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bounds: Bounds | None = None) -> Model:
    """Learn one model per language; each language's sample is one bounded group."""
    bounds = bounds or Bounds()
    sample = labelled_sample(docs, text_col, lang_col, bounds)

    def fit_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        held = group["key"].to_numpy() % 5 == 0
        texts = group["text"][~held].tolist() or group["text"].tolist()
        if not any(c.isalpha() for t in texts for c in t):
            return pd.DataFrame({"lang": [], "model": [], "held": []}, dtype=object)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "model": [_pack(fit_language(texts))],
                             "held": [group["text"][held].tolist()]})

    got = sample.groupBy("lang").applyInPandas(
        fit_group, "lang string, model binary, held array<string>").limit(bounds.languages + 1).collect()
    if len(got) > bounds.languages:
        raise ValueError(f"more than {bounds.languages} languages")
    got.sort(key=lambda r: r["lang"])
    model = Model([r["lang"] for r in got], [_unpack(bytes(r["model"])) for r in got])
    if model.size() > bounds.model_bytes:
        raise ValueError(f"the models take {model.size()} bytes: lower characters_per_language")
    model.calibrate([t for r in got for t in r["held"]], [r["lang"] for r in got for _ in r["held"]])
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of every whole text.

    Returns one row per row: doc_id, lang_pred (``und`` for null texts and texts
    without a letter, or when nothing was learned), score (0 to 1), cross_entropy
    and margin to the next language (null where ``und``), rejected.  Ties go to
    the first language by code point.  Repeated rows give repeated results; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by Bounds

    def scored(batches):
        for ids, texts in in_slices(batches, 2_000_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *(pa.array(v, t) for v, t in zip(
                    shared.value.predict(texts), (pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())))],
                names=["doc_id", "lang_pred", "score", "cross_entropy", "margin", "rejected"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scored, SCHEMA)
