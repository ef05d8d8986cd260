import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def plain(emission, lengths, step, start):
    """Forward-backward per text over explicit states."""
    out, pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        e = [np.exp([0.0, x]) for x in emission[at:at + n]]
        t = np.exp(step)
        f = [np.array([1.0, np.exp(start)]) * e[0]]
        for x in e[1:]:
            f.append((f[-1] @ t) * x)
        b = [np.ones(2)]
        for x in e[:0:-1]:
            b.insert(0, t @ (x * b[0]))
        z = f[-1].sum()
        out += [(x * y)[1] / z for x, y in zip(f, b)]
        for k in range(1, n):
            pairs += f[k - 1][:, None] * t * (e[k] * b[k])[None, :] / z
        at += n
    return np.array(out), pairs


@pytest.mark.parametrize("lengths", [[1], [5, 1, 3], [300, 2, 140], [128, 128]])
def test_forward_backward(lengths):
    random = np.random.default_rng(len(lengths))
    emission = random.normal(0, 0.7, sum(lengths))
    step, start = random.normal(0, 0.5, (2, 2)), 0.3
    ends = toxicity._ends(np.array(lengths))
    p, pairs = toxicity.step_counts(emission, *ends, step, start)
    want, want_pairs = plain(emission, lengths, step, start)
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs.ravel())
    assert np.allclose(toxicity.marginals(emission, *ends, step, start), want)


def test_strong_weights_over_long_texts_stay_finite():
    n = 50_000
    ends = toxicity._ends(np.array([n]))
    p = toxicity.marginals(np.where(np.arange(n) % 1000 == 0, 40.0, -40.0), *ends, np.zeros((2, 2)), 0.0)
    assert np.isfinite(p).all() and (p[::1000] > 0.99).all() and p.sum() < 51


def test_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op9_toxicity(spark, SF)
    assert got.count() == got.filter("score between 0 and 1").count() == 10_000
    assert got.filter("predicted <> int(score >= 0.5)").count() == 0
    held = got.filter("held_out").join(labels, "doc_id")
    assert held.filter("predicted = toxic").count() >= 0.98 * held.count()


def test_spans_cover_the_offending_words(spark):
    rows = [(i, ("the day was fine and calm " * 3) + (f"so {w}{i} it" if i % 2 else "so be it") + f" n{i}", i % 2)
            for i, w in ((i, "grumf" if i % 4 == 1 else "zorkel") for i in range(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    words = [" ".join(f"x{(i * 7 + k * 13) % 997}" for k in range(20)) for i in range(400)]
    docs = docs.join(spark.createDataFrame(list(enumerate(words)), "doc_id long, more string"), "doc_id").withColumn(
        "text", F.concat_ws(" ", "more", "text"))
    model = toxicity.fit(docs.select("doc_id", "text"), docs.filter("doc_id % 5 <> 0").select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in range(0, 400, 5):
        assert got[i]["predicted"] == i % 2
        found = [text[i][int(a):int(b)] for a, b in (s.split(":") for s in got[i]["spans"].split(",") if s)]
        assert bool(found) == bool(i % 2) and all(w.startswith(("grumf", "zorkel")) for w in found)


def test_rough_rows(spark, rough):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (9, None), (77, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.filter("toxic = 1")):
        model = toxicity.fit(rough, some)
        got = toxicity.score(rough, model)
        assert got.count() == rough.count() and got.filter("score is null or not score between 0 and 1").count() == 0
        same = {r["score"] for r in got.filter("doc_id in (2, 3, 4)").collect()}
        assert len(same) == 1
        kept = toxicity.drop_toxic(rough, model)
        assert kept.columns == rough.columns and kept.count() == got.filter("predicted = 0").count()
    assert toxicity.score(rough.limit(0), model).count() == 0
    assert toxicity.drop_toxic(rough.limit(0), model).columns == rough.columns


@pytest.mark.parametrize("sf, share", [("sf0.001", 0.5), ("sf0.01", 0.6)])
def test_few_labels(spark, sf, share):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").cache()
    assert got.filter("predicted = 1 and toxic = 1").count() >= share * got.filter("toxic = 1").count()
    assert got.filter("predicted = 1 and toxic = 0").count() == 0
