"""The corpus pipeline, stage by stage, against plain code on the same rows."""

import re
from collections import defaultdict

import corpus_pipeline
from lakewarden.llm import mixing, queries, toxicity
from tests.llm.test_near_copies import plain_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns

    before, after = kept["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()}
    assert all(labels.get(i, 1) == 1 for i in gone)

    before, after = kept["exact_dedup"]
    groups = defaultdict(list)
    for r in before.collect():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(min(g)[1] for g in groups.values())

    before, after = kept["simhash"]
    near = plain_components([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(near.values()))
    assert after.count() < before.count()

    before, after = kept["mixing"]
    times = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.mix(before).collect() if r["taken"]}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, n in times.items() for _ in range(n))

    before, after = kept["packing"]
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before.collect())
    assert after.groupBy().sum("length").first()[0] == words


def test_rough_and_empty_tables(spark, rough):
    for docs in (rough, rough.limit(0)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF).cache()
            if name != "packing":
                assert docs.columns == rough.columns
                ids = {r["doc_id"] for r in before.select("doc_id").collect()}
                assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= ids
            assert (docs.count() > 0) == (n > 0)


def test_toxic_documents_are_dropped(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    gone = docs.join(corpus_pipeline.not_toxic(spark, docs, sf).select("doc_id"), "doc_id", "left_anti")
    marked = gone.join(labels, "doc_id")
    assert gone.count() >= 50 and marked.filter("toxic = 1").count() >= 0.98 * marked.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_operator_is_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_rejects_by_score(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r[0] for r in toxicity.drop_toxic(docs, model).select("doc_id").collect()}
    assert kept == {r[0] for r in toxicity.score(docs, model).filter("score < 0.5").select("doc_id").collect()}
