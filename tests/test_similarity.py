"""Near sets against a product of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import similarity


def plain(sets, percent):
    out = {}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                out[i, j] = len(a & b)
    return out


def frame(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "set_id long, tokens array<string>")


@pytest.mark.parametrize("percent", [1, 34, 60, 75, 100])
def test_pairs(spark, percent):
    draw = random.Random(percent)
    sets = {0: set(), 1: {"a"}}
    for i in range(2, 90):
        own = {draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 7))}
        sets[i] = own | ({"hot"} if i % 3 else set())
    for block in (4, 4096):
        got = {(r.a, r.b): r.common for r in similarity.near_pairs(frame(spark, sets), percent, block).collect()}
        assert got == plain(sets, percent)
        assert similarity.near_pairs(frame(spark, sets), percent, block).count() == len(got)


@pytest.mark.parametrize("percent", [49, 50, 60, 80, 100])
def test_sets_below_and_above_small(spark, percent):
    draw = random.Random(percent)
    sets = {}
    for i in range(150):
        like = sets[draw.randrange(i)] if i % 3 else set()
        fresh = {f"t{draw.randrange(24)}" for _ in range(draw.choice([1, 2, 4, 11, 20]))}
        sets[i] = {t for t in like if draw.random() < 0.9} | (set(sorted(fresh)[:2]) if like else fresh)
    sizes = {len(s) for s in sets.values()}
    assert min(sizes) < 3 and max(sizes) > similarity.SMALL + 2
    for block in (3, 4096):
        got = similarity.near_pairs(frame(spark, sets), percent, block).collect()
        assert {(r.a, r.b): r.common for r in got} == plain(sets, percent) and len(got) == len(plain(sets, percent))


def test_a_shared_token_alone_makes_no_candidates(spark):
    sets = {i: {f"a{i % 20}", f"b{i // 20}", f"c{(7 * i + i // 20) % 20}"} for i in range(400)}
    ordered = similarity.by_rarity(frame(spark, sets))
    rows = similarity.postings(ordered, 75)
    a, b = (similarity.keyed(rows, 75, smaller) for smaller in (True, False))
    # Of the 400 sets, 20 share each token, and one or two each pair.
    assert a.join(b, ["token", "least", "low", "high"]).count() < 4 * len(sets)


def test_a_hot_token_is_split(spark):
    sets = {i: {"hot", f"x{i % 3}"} for i in range(600)}
    ordered = frame(spark, sets).select("set_id", F.size("tokens").alias("size"), "tokens")
    rows = similarity.postings(ordered, 30, 50)
    for smaller in (True, False):
        most = similarity.keyed(rows, 30, smaller).groupBy("token", "least", "low", "high").count().agg(F.max("count")).first()[0]
        assert most <= 100


def test_classes(spark, rows):
    df = spark.createDataFrame(
        [(1, ["a", "b", "c"], True), (2, ["c", "b", "a", "a", None], True), (3, ["a", "b", "d"], True), (4, ["a", "b"], None),
         (5, None, True), (6, [], True), (7, ["z"], False)], "k int, t array<string>, v boolean")
    got = rows(similarity.near_classes(df, "k", "t", "v"))
    # a b c is near a b only, which is near a b d, too; 5 and 6 have no token.
    assert got == [(1, 1, 2, 1, 1), (2, 1, 2, 1, 1), (3, 3, 1, 1, 0), (4, 4, 1, 2, 3), (5, 5, 2, 0, 1), (6, 5, 2, 0, 1),
                   (7, 7, 1, 0, 0)]
    assert similarity.near_classes(df.limit(0), "k", "t", "v").count() == 0
    with pytest.raises(ValueError, match="percent"):
        similarity.near_pairs(df, 0)
