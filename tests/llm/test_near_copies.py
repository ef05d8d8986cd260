"""Near copies against plain sets of words, with whole groups and with groups cut into chunks."""

import random

import pytest
from lakewarden.llm import near_copies


def plain_components(rows, similar=0.8):
    """Least id reachable over pairs of at least the similarity, from all pairs that share a shingle."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset([b" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))] if words else [])
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    holders = {}
    for i in sorted(sets):
        shared = {}
        for s in sets[i] or [None]:
            for j in holders.get(s, ()):
                shared[j] = shared.get(j, 0) + 1
            holders.setdefault(s, []).append(i)
        for j, n in shared.items():
            if not sets[i] or n >= similar * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                least[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def found(docs, **how):
    return {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, **how).collect()}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = plain_components(rows)
    assert found(docs) == want and len(set(want.values())) < len(rows)


def crowd(spark, similar_words):
    """A third of the rows are copies of one text with some words changed, then pairs and others."""
    dice = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        text = list(words)
        for _ in range(dice.randrange(similar_words)):
            text[dice.randrange(len(text))] = f"x{dice.randrange(10 ** 6)}"
        rows.append((i, " ".join(text)))
    for i in range(120, 360, 2):
        text = [f"y{dice.randrange(10 ** 6)}" for _ in range(60)]
        rows += [(i, " ".join(text)), (i + 1, " ".join([*text[:-1], "end"]))]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("limit", [near_copies.LIMIT, 3_000])
def test_crowd(spark, limit):
    docs, rows = crowd(spark, 12)
    want = plain_components(rows)
    assert found(docs, limit=limit) == want and len(set(want.values())) < 150


def test_rough_rows(spark, rough):
    got = found(rough)
    # Equal but for case and white space; without words; repeated ids; short texts; the row without an id is not there.
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, 6: 1, 8: 8, 9: 9, 10: 10, 11: 11, 12: 12, 13: 12}
    kept = near_copies.drop_near_copies(rough)
    assert kept.columns == rough.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids, key=str) == sorted([1, 2, None, 8, 9, 9, 10, 11, 12], key=str)


def test_empty_table(spark, rough):
    assert found(rough.limit(0)) == {}
    assert near_copies.drop_near_copies(rough.limit(0)).count() == 0
