"""Lyndon arrays and periodic runs against plain code."""

import re
import zlib
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from lakewarden.llm import queries, runs

WORDS = "[^\\x20\\x09-\\x0D]+"


def plain_lyndon(s):
    def lyndon(w):
        return all(w < w[k:] for k in range(1, len(w)))
    return [max(n for n in range(1, len(s) - i + 1) if lyndon(s[i:i + n])) for i in range(len(s))]


def plain_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            piece = words[i:i + length]
            smallest = all(any(piece[k] != piece[k + p] for k in range(length - p)) for p in range(1, q))
            if length >= max(6, 4 * q) and smallest:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=24))
def test_lyndon_arrays(codes):
    assert runs.lyndon_array(codes) == plain_lyndon(codes)
    assert runs.lyndon_array([-c for c in codes]) == plain_lyndon([-c for c in codes])


PIECES = st.lists(st.one_of(
    st.lists(st.sampled_from("abcd"), max_size=6),
    st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 9)).map(lambda x: x[0] * x[1]),
    st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=3), st.integers(2, 7), st.integers(2, 7)).map(
        lambda x: (x[0] * x[1] + ["z"]) * x[2])), max_size=5).map(lambda parts: [w for p in parts for w in p])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, min_size=1, max_size=4))
def test_runs(texts):
    assert runs.text_runs([[w.encode() for w in t] for t in texts]) == [plain_runs(t) for t in texts]


def test_long_texts():
    rising = [str(k).encode() for k in range(50_000)]
    fib = ["a", "b"]
    while len(fib) < 5_000:
        fib = fib + fib[:len(fib) * 8 // 13]
    same = [b"x"] * 200_000
    got = runs.text_runs([rising, same, rising[:100] * 500, [w.encode() for w in fib]])
    assert got[:3] == [[], [(0, 200_000, 1)], [(0, 50_000, 100)]]


def damaged(i, text):
    words = re.findall(WORDS, text or "")
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words, r = damaged(d["doc_id"], d["text"]), got[d["doc_id"]]
        found = plain_runs(words)
        some += bool(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == sha256(lines.encode()).hexdigest()
        assert r["collapsed_sha256"] == sha256(kept.encode()).hexdigest()
    assert some >= 10


def test_rough_rows(spark, rough):
    got = runs.run_report(runs.periodic_runs(rough))
    assert got.count() == rough.count() and runs.periodic_runs(rough.limit(0)).count() == 0
    rows = {r["doc_id"]: r for r in runs.periodic_runs(rough).collect()}
    assert rows[8]["runs"] == [(0, 160_000, 4)] and rows[8]["collapsed"] == "Thou anon, the ererst."
    assert rows[2]["runs"] == [] and rows[2]["n_words"] == 0 and rows[2]["collapsed"] == ""
    assert runs.with_repeats(rough).count() == rough.count() and runs.with_repeats(rough.limit(0)).count() == 0
