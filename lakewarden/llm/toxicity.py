"""Toxicity with a linear-chain conditional random field over words.

Labels exist for documents only, so words are labelled first: a word of a toxic
document is toxic if its form, beginning or ending occurs in toxic documents far more
often than chance allows.  A field with two states learns weights for forms,
beginnings and endings and for the steps between states from these sequences.
Forward-backward gives each word's marginal; their sum, their highest value and their
share, read by a logistic curve that is fitted to the documents' labels, give the
score, and runs of words above one half give the offending offsets.

The chain of odds is a product of 2 x 2 matrices, so one pass over many texts at once
takes a fixed number of numpy steps: rows of ``ROW`` words are multiplied out side by
side, carried from row to row, and filled in.
"""

from __future__ import annotations

import pickle
import re
import string
import uuid
from dataclasses import dataclass, field
from itertools import chain as joined

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.fingerprints import signatures
from lakewarden.llm.text import id_and_text, in_slices, numbered, restored

ROW = 128
CLIP = 12.0
# What is cut from the ends of a word.
EDGE = string.punctuation + "\u2018\u2019\u201c\u201d\u201e\u00ab\u00bb\u2026\u2013\u2014\u00bf\u00a1"
RUN = re.compile(r"\S+")
SCHEMA = "doc_id long, score double, predicted int, spans string"


@dataclass
class Bounds:
    """What the training sample may hold."""

    toxic: int = 1_000
    clean: int = 2_000
    characters: int = 40_000
    features: int = 200_000
    rounds: int = 30


def parts(word: str) -> list[str]:
    """The features of a word: its form, its beginnings and its ending."""
    word = word.strip(EDGE)
    n = len(word)
    if n < 4:
        return [f"w{word}", f"b{word}"] if n == 3 else [f"w{word}"] if n else []
    return [f"w{word}", f"e{word[-4:]}", *(f"b{word[:k]}" for k in range(3, min(n, 6) + 1))]


def chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """r[t] = (a[t] r[t-1] + b[t]) / (c[t] r[t-1] + d[t]) for all t, from r[-1] = 1."""
    n = len(a)
    rows = -(-n // ROW)
    shaped = []
    for values, neutral in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)):
        full = np.full(rows * ROW, neutral)
        full[:n] = values
        shaped.append(np.ascontiguousarray(full.reshape(rows, ROW).T))
    a, b, c, d = shaped
    p, q, r, s = a[0], b[0], c[0], d[0]
    for k in range(1, ROW):
        p, q, r, s = a[k] * p + b[k] * r, a[k] * q + b[k] * s, c[k] * p + d[k] * r, c[k] * q + d[k] * s
        scale = 1 / (p + q + r + s)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    carry, starts = 1.0, []
    for w, x, y, z in zip(p.tolist(), q.tolist(), r.tolist(), s.tolist()):
        starts.append(carry)
        carry = (w * carry + x) / (y * carry + z)
    out = np.empty((ROW, rows))
    now = np.array(starts)
    for k in range(ROW):
        now = (a[k] * now + b[k]) / (c[k] * now + d[k])
        out[k] = now
    return out.T.ravel()[:n]


def passes(emission: np.ndarray, first: np.ndarray, last: np.ndarray, step: np.ndarray, start: float):
    """Odds of the toxic state from the words so far, from the words after, and the emission's own.

    ``first`` and ``last`` mark the ends of the texts; ``step[i, j]`` is the log weight
    from state i to j, ``start`` that of beginning toxic.
    """
    e = np.exp(np.clip(emission, -CLIP, CLIP))
    t = np.exp(step)
    forward = chain(np.where(first, 0, e * t[1, 1]), np.where(first, e * np.exp(start), e * t[0, 1]),
                    np.where(first, 0, t[1, 0]), np.where(first, 1, t[0, 0]))
    after = np.r_[e[1:], 1.0]
    backward = chain(np.where(last, 0, after * t[1, 1])[::-1], np.where(last, 1, t[1, 0])[::-1],
                     np.where(last, 0, after * t[0, 1])[::-1], np.where(last, 1, t[0, 0])[::-1])[::-1]
    return forward, backward, e


def marginals(emission: np.ndarray, first: np.ndarray, last: np.ndarray, step: np.ndarray, start: float) -> np.ndarray:
    """Probability of the toxic state at each word."""
    if not len(emission):
        return np.zeros(0)
    forward, backward, _ = passes(emission, first, last, step, start)
    odds = forward * backward
    return odds / (1 + odds)


def step_counts(emission: np.ndarray, first: np.ndarray, last: np.ndarray, step: np.ndarray, start: float):
    """Marginals, and the expected number of steps between each two states."""
    forward, backward, e = passes(emission, first, last, step, start)
    odds = forward * backward
    t = np.exp(step)
    before = np.r_[1.0, forward[:-1]]
    pairs = np.stack([np.full(len(e), t[0, 0]), t[0, 1] * e * backward, t[1, 0] * before,
                      t[1, 1] * before * e * backward])
    pairs = (pairs / pairs.sum(0))[:, ~first]
    return odds / (1 + odds), pairs.sum(1)


def _ends(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros((2, int(counts.sum())), bool)
    own = counts[counts > 0]
    first[np.cumsum(own) - own] = True
    last[np.cumsum(own) - 1] = True
    return first, last


def _summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text: the largest marginal's odds, the weight of the high marginals, and their share."""
    out = np.zeros((len(counts), 3))
    out[:, 0] = np.log(1e-6) / 4
    full = np.flatnonzero(counts)
    if len(full):
        at = np.cumsum(counts[full]) - counts[full]
        heavy, top = np.add.reduceat(p * p, at), np.maximum.reduceat(p, at)
        top = np.clip(top, 1e-6, 1 - 1e-6)
        out[full] = np.stack([np.log(top / (1 - top)) / 4, np.log1p(heavy), 10 * heavy / counts[full]], 1)
    return out


@dataclass
class Field:
    """The learned weights; without toxic or clean documents only a constant score."""

    constant: float | None = None
    weights: dict[str, float] = field(default_factory=dict)
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    bias: float = 0.0
    curve: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def score(self, texts: list[str], known: dict[str, float]) -> tuple[np.ndarray, list[str]]:
        """Scores and offending offsets of whole texts; ``known`` remembers words' weights."""
        if self.constant is not None:
            return np.full(len(texts), self.constant), [""] * len(texts)
        lists = [t.lower().split() for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        values = np.fromiter(map(known.__getitem__, joined.from_iterable(lists)), np.float64, int(counts.sum()))
        p = marginals(values, *_ends(counts), self.step, self.start)
        x = _summary(p, counts)
        z = np.clip(x @ self.curve[:3] + self.curve[3], -30, 30)
        spans = [""] * len(texts)
        ends = np.cumsum(counts)
        for i in np.unique(np.searchsorted(ends, np.flatnonzero(p >= 0.5), side="right")):
            spans[i] = _offsets(texts[i], p[ends[i] - counts[i]:ends[i]] >= 0.5)
        return 1 / (1 + np.exp(-z)), spans


class Known(dict):
    """Words' emission weights; remembers words up to a bound."""

    def __init__(self, model: Field, bound: int = 400_000):
        super().__init__()
        self.model, self.bound, self.get_weight = model, bound, model.weights.get

    def __missing__(self, word: str) -> float:
        get = self.get_weight
        value = self.model.bias
        for f in parts(word):
            value += get(f, 0.0)
        if len(self) < self.bound:
            self[word] = value
        return value


_WORKER: dict[str, Known] = {}


def _known(model: Field, key: str) -> Known:
    """One memory of words per Python worker and model, kept across tasks."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Known(model)
    return _WORKER[key]


def _offsets(text: str, marked: np.ndarray) -> str:
    """``start:end`` of runs of marked words, in code points."""
    out, open_ = [], None
    for m, hit in zip(RUN.finditer(text), marked):
        if hit:
            open_ = (open_[0] if open_ else m.start(), m.end())
        elif open_:
            out.append(open_)
            open_ = None
    if open_:
        out.append(open_)
    return ",".join(f"{a}:{b}" for a, b in out)


def _different(texts: list[str]) -> list[int]:
    """Texts without the near copies of an earlier one, so that no group of copies outweighs the rest."""
    seen, out = set(), []
    for i, row in enumerate(signatures(texts)):
        bands = [(k, row[k:k + 4].tobytes()) for k in range(0, 64, 4)]
        if not any(b in seen for b in bands):
            out.append(i)
        seen.update(bands)
    return out


def train(texts: list[str], toxic: list[int], bounds: Bounds) -> Field:
    """Learn a field from labelled texts."""
    keep = _different(texts)
    texts, label = [texts[i] for i in keep], np.array([toxic[i] for i in keep], bool)
    if label.all() or not label.any():
        return Field(constant=float(label.mean()) if len(label) else 0.0)
    lists = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    forms: dict[str, int] = {}
    ids = np.fromiter((forms.setdefault(w, len(forms)) for words in lists for w in words), np.int64, int(counts.sum()))
    text_of = np.repeat(np.arange(len(lists)), counts)

    names: dict[str, int] = {}
    pairs = [(i, names.setdefault(f, len(names))) for i, w in enumerate(forms) for f in parts(w)]
    form_of, feature_of = np.array(pairs, np.int64).reshape(-1, 2).T
    held = np.unique(text_of * len(forms) + ids)
    texts_with = [np.flatnonzero(label), np.flatnonzero(~label)]
    seen = []
    for some in texts_with:
        own = held[np.isin(held // len(forms), some)]
        order = np.argsort(form_of, kind="stable")
        low = np.searchsorted(form_of[order], own % len(forms))
        high = np.searchsorted(form_of[order], own % len(forms), side="right")
        at = np.repeat(low - np.r_[0, np.cumsum(high - low)[:-1]], high - low) + np.arange((high - low).sum())
        both = np.unique((np.repeat(own // len(forms), high - low)) * len(names) + feature_of[order][at])
        seen.append(np.bincount(both % len(names), minlength=len(names)).astype(float))
    bad, good = seen
    n_bad, n_good = label.sum(), (~label).sum()
    share = (bad + good) / (n_bad + n_good)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = sum(np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / (n * np.maximum(y, 1e-12))), 0)
                   for x, n, y in ((bad, n_bad, share), (n_bad - bad, n_bad, 1 - share),
                                   (good, n_good, share), (n_good - good, n_good, 1 - share)))
    # Twice the gain of a feature without meaning passes 2 ln(m) about once among m features, whatever the number of labels.
    marks = (2 * gain >= 2 * np.log(max((bad > 1).sum(), 2))) & (bad / n_bad >= 20 * (good + 0.5) / n_good)
    toxic_form = np.zeros(len(forms), bool)
    toxic_form[form_of[marks[feature_of]]] = True
    y = (toxic_form[ids] & label[text_of]).astype(float)

    use = (bad + good >= 3) | marks
    if use.sum() > bounds.features:
        order = np.argsort(-(gain + 1e3 * marks), kind="stable")
        use = np.zeros(len(names), bool)
        use[order[:bounds.features]] = True
    chosen = use[feature_of]
    form_of, feature_of = form_of[chosen], feature_of[chosen]
    model = Field(bias=float(np.log((y.sum() + 1) / (len(y) + 2))))
    weights, squares = np.zeros((2, len(names)))
    rest, rest_squares = np.zeros((2, 6))  # bias, start, four steps
    rest[0] = model.bias
    first, last = _ends(counts)
    follows = np.flatnonzero(~first)
    seen_steps = np.bincount((2 * y[follows - 1] + y[follows]).astype(int), minlength=4)
    for _ in range(bounds.rounds):
        emission = rest[0] + np.bincount(form_of, weights[feature_of], len(forms))[ids]
        p, steps = step_counts(emission, first, last, rest[2:].reshape(2, 2), rest[1])
        error = np.bincount(ids, y - p, len(forms))
        slope = np.bincount(feature_of, error[form_of], len(names)) - 1e-2 * weights
        rest_slope = np.array([(y - p).sum(), (y - p)[first].sum(), *(seen_steps - steps)]) - 1e-2 * rest
        squares += slope ** 2
        rest_squares += rest_slope ** 2
        weights += 0.6 * slope / np.sqrt(squares + 1e-8)
        rest += 0.1 * rest_slope / np.sqrt(rest_squares + 1e-8)
    weights[~use] = 0
    model.bias, model.start, model.step = float(rest[0]), float(rest[1]), rest[2:].reshape(2, 2)
    model.weights = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) > 1e-3}
    emission = model.bias + np.bincount(form_of, weights[feature_of], len(forms))[ids]
    p = marginals(emission, first, last, model.step, model.start)
    model.curve = _logistic(_summary(p, counts), label)
    return model


def _logistic(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights of a regularised logistic curve; the last is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.1] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (label - p) - ridge @ w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge
        change = np.linalg.solve(curve, slope)
        w += change * min(1.0, 5 / np.abs(change).max())
        if np.abs(change).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", bounds: Bounds | None = None) -> Field:
    """Learn from a sample of labelled documents within ``bounds``, chosen by the hash of the id.

    ``labels`` has the id and the label (0 or 1, rows without either are passed over; an
    id with both counts as toxic).  Labelled rows without a text, or with one of more than
    ``bounds.characters``, are not learned from.  Each task keeps the least hashes of its own labels; the sampled texts
    are one bounded group.
    """
    bounds = bounds or Bounds()
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")
                           ).filter("doc_id is not null and toxic in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    least = [marked.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
             for value, n in ((1, bounds.toxic), (0, bounds.clean))]
    ranked = least[0].unionAll(least[1])
    sample = id_and_text(docs, id_col, text_col).join(
        F.broadcast(ranked), "doc_id").filter(  # at most toxic + clean rows
        F.length("text") <= bounds.characters).dropDuplicates(["doc_id"])

    def learned(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        model = train(group["text"].tolist(), group["toxic"].tolist(), bounds)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    got = sample.select(F.lit(0).alias("all"), "doc_id", "text", "toxic").groupBy("all").applyInPandas(
        learned, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else Field(constant=0.0)


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text.

    Returns one row per row: doc_id, score (0 to 1), predicted (1 from 0.5), spans
    (``start:end`` of offending words, joined by commas).  Null counts as empty; an
    empty text gets the score of a text without a toxic word; repeated rows give
    repeated results; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most Bounds.features weights
    key = uuid.uuid4().hex

    def scored(batches):
        known = _known(shared.value, key)
        for ids, texts in in_slices(batches, 4_000_000):
            value, spans = shared.value.score(texts, known)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(value, pa.float64()),
                 pa.array((value >= 0.5).astype(np.int32), pa.int32()), pa.array(spans, pa.string())],
                names=["doc_id", "score", "predicted", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(scored, SCHEMA)


def drop_toxic(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, with the columns they came with.

    Null counts as empty, and an empty text is scored like one without a toxic word;
    repeated rows are judged alike; an empty table stays empty.  Columns may have any
    name, dots included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, _ = numbered(docs, text_col)
    place, key = docs.columns.index(text_col), uuid.uuid4().hex

    def kept(batches):
        known = _known(shared.value, key)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).cast(pa.string()).to_pylist()]
            keep: list[np.ndarray] = []
            for k, size in _cuts(texts):
                keep.append(shared.value.score(texts[k:k + size], known)[0] < 0.5)
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return restored(rows.mapInArrow(kept, rows.schema), docs.columns)


def _cuts(texts: list[str], budget: int = 4_000_000):
    """(start, number) of runs of texts of about ``budget`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 64
        if size >= budget:
            yield start, i + 1 - start
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts) - start
