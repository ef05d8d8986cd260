"""Versioned publishing, broken JSON, rates from a table, failed casts."""

import pytest
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.functions import columns as X
from lakewarden.operators import rules
from lakewarden.plans import history_queries, medallion
from lakewarden.sources import tables, versions


def test_a_run_that_ends_between_two_tables_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path)
    assert versions.latest(spark, root) == (0, {})

    def publish(n, broken=False):
        fails = spark.range(n).select(F.raise_error(F.lit("lost"))) if broken else spark.range(n)
        return versions.publish(spark, root, {"a": spark.range(n), "b": fails})

    def seen():
        return [versions.read(spark, root, t).count() for t in ("a", "b")]

    for n in range(1, 5):
        assert publish(n) == n and seen() == [n, n]
        with pytest.raises(Exception, match="lost"):
            publish(50, broken=True)
        assert seen() == [n, n] and versions.latest(spark, root)[0] == n
    assert spark.read.parquet(f"{root}/manifest").count() == 4


def test_broken_documents_and_lines(spark, tmp_path):
    def write(name, *texts):
        (tmp_path / name).mkdir()
        for k, text in enumerate(texts):
            (tmp_path / name / f"{k}.json").write_text(text)
        return str(tmp_path / name)

    folder = write("documents", '{"incident_id": "A",\n "affected_assets": ["x"]}', '{"incident_id": "B", ', '[1, 2', '{"incident_id": "C"}',
                   '{"incident_id": "D", "affected_assets": 7}')
    good, bad = tables.split_corrupt(tables.read_incidents(spark, folder))
    assert {r.incident_id for r in good.collect()} == {"A", "C"}
    assert {(r.source_file, r.text[:18]) for r in bad.collect()} == {("1.json", '{"incident_id": "B'), ("2.json", "[1, 2"),
                                                                     ("4.json", '{"incident_id": "D')}
    folder = write("lines", '{"event_id": "1", "actor": "x"}\n\n{"event_id": \n"nothing"\n{"event_id": "2"}\n')
    good, bad = tables.split_corrupt(tables.read_events(spark, folder))
    assert {r.event_id for r in good.select("event_id").collect()} == {"1", "2"}
    assert {r.text for r in bad.select("text").collect()} == {'{"event_id": ', '"nothing"'}


@pytest.mark.parametrize("n", [0, 1, 40])
def test_documents_are_written_by_many_tasks(spark, rows, tmp_path, n):
    suppliers = [(k, None if k % 7 == 0 else f"S{k}", k % 3, None if k % 5 == 0 else float(k - 20)) for k in range(n)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(
        str(tmp_path / "supplier.parquet"))
    out = history_queries.incident_files(spark, str(tmp_path))
    files = [f.rsplit("/", 1)[1] for f in out.inputFiles()]
    assert rows(out, "incident_id", "severity") == sorted((f"SUP-{k}", "P1" if b is not None and b < 0 else "P3") for k, _, _, b in suppliers)
    assert len(files) >= n and len({f[:10] for f in files}) >= min(n, 4)


def test_rates_from_a_table(spark, rows):
    rates = spark.createDataFrame([("USD", 1000), ("EUR", 1100)], "currency string, thousandths int")
    df = spark.createDataFrame([(1, "EUR"), (2, "USD"), (3, "XXX"), (4, None), (5, "EUR")], "k int, currency string")
    got = X.fx_from_table(df, rates)
    assert rows(got, "k", "rate_thousandths", "unknown_currency") == [
        (1, 1100, False), (2, 1000, False), (3, 1000, True), (4, 1000, True), (5, 1100, False)]
    assert got.columns == ["k", "currency", "rate_thousandths", "unknown_currency"]
    assert X.fx_from_table(df, rates.limit(0)).filter("unknown_currency").count() == 5


def test_failed_casts_are_marked(spark, rows):
    df = spark.createDataFrame([("1", "10", "5.5"), ("2", "ten", "5.5"), ("3", None, None), ("4", "1", "9" * 17),
                                ("5", " 7 ", "9" * 16)], "k string, total_orders string, lifetime_value string")
    typed = medallion.set_types(df, medallion.CAST_RULE.mark)
    assert rows(typed, "k", medallion.CAST_RULE.mark) == [("1", False), ("2", True), ("3", False), ("4", True), ("5", False)]
    flagged = rules.apply(typed, [medallion.CAST_RULE])
    assert rows(flagged, "k", "total_orders", "data_quality_flags")[1] == ("2", None, fixed.FLAG_CAST_FAILED)
