import pytest
from pyspark.sql import functions as F

from lakewarden.operators import dedup
from lakewarden.operators.rules import Rule
from lakewarden.streaming import events as stream
from lakewarden.streaming import generations

SCHEMA = "id int, ts timestamp, kind string"


def arrive(spark, folder, *rows):
    spark.createDataFrame([(i, m, k) for i, m, k in rows], "id int, m int, kind string").select(
        "id", F.timestamp_seconds(F.col("m") * 60 + 864000).alias("ts"), "kind").write.mode("append").parquet(
        f"{folder}/in")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def source(spark, folder):
    return stream.read_files(spark, f"{folder}/in", SCHEMA)


def run_dedup(spark, folder, files_per_batch=None):
    arriving = stream.read_files(spark, f"{folder}/in", SCHEMA, files_per_batch)
    stream.write_split(arriving, "ts", "10 minutes", folder, f"{folder}/split")
    on_time = stream.read_on_time(spark, folder, arriving.schema)
    stream.write_append(stream.deduplicated(on_time, ["id"], "ts", "10 minutes"),
                        f"{folder}/out", f"{folder}/checkpoint")
    return arriving.schema


def test_late_rows_go_to_a_side_table(spark, folder, rows):
    arrive(spark, folder, (1, 0, "a"), (2, 100, "a"), (9, None, "a"))
    run_dedup(spark, folder)
    # A copy, a row at the bound and one before it, and new rows.
    arrive(spark, folder, (1, 0, "a"), (2, 100, "a"), (3, 101, "b"), (4, 90, "b"), (5, 91, "b"), (5, 91, "b"))
    schema = run_dedup(spark, folder)
    run_dedup(spark, folder)  # nothing new
    out = spark.read.parquet(f"{folder}/out")
    assert [r[0] for r in rows(out, "id")] == [1, 2, 3, 5, 9]
    assert rows(stream.late_rows(spark, folder, schema), "batch", "id") == [(1, 1), (1, 4)]
    assert rows(stream.late_counts(spark, folder, schema, out, ["id"])) == [(0, 0, 0), (1, 2, 1)]


def test_late_rows_of_more_than_a_hundred_batches(spark, folder, rows):
    """Every third file holds a row that is late; all are counted."""
    n = 105
    (spark.range(n).repartitionByRange(n, "id").select(
        F.col("id").cast("int").alias("id"),
        F.timestamp_seconds(F.when(F.col("id") % 3 == 2, 0).otherwise(F.col("id") * 60) + 864000).alias("ts"),
        F.lit("a").alias("kind")).write.parquet(f"{folder}/in"))
    schema = run_dedup(spark, folder, 1)
    got = stream.late_rows(spark, folder, schema)
    in_order, top, want = [r.id for r in spark.read.schema(_with_batch(schema)).parquet(f"{folder}/rows")
                           .orderBy("batch").collect()], None, []
    for i in in_order:
        minute = 0 if i % 3 == 2 else i
        if top is not None and minute <= top - 10:
            want.append(i)
        top = minute if top is None else max(top, minute)
    assert len(in_order) == n and len(want) > 20
    assert [r[0] for r in rows(got.select(F.format_string("%03d", "id")))] == [f"{i:03d}" for i in sorted(want)]


def _with_batch(schema):
    return stream._split_schema(schema)


def test_window_split_sets_rows_without_a_time_aside(spark, folder, rows):
    arrive(spark, folder, (1, 0, "a"), (2, 300, "a"), (3, None, "a"))
    for _ in range(2):
        arriving = source(spark, folder)
        stream.write_split(arriving, "ts", "2 hours", folder, f"{folder}/split", "1 hour")
        # The window of minute 130 ends at 180, the bound, that of minute 190 after it.
        arrive(spark, folder, (4, 130, "a"), (5, 190, "a"))
    assert rows(stream.late_rows(spark, folder, arriving.schema), "batch", "id") == [(0, 3), (1, 4)]


def test_window_counts(spark, folder, rows):
    def run():
        counted = stream.window_counts(source(spark, folder), "ts", "1 hour", ["kind"], "2 hours")
        stream.write_updates(counted, f"{folder}/out", f"{folder}/checkpoint", ["window_start", "kind"], "n_events")
    arrive(spark, folder, (1, 0, "a"), (2, 59, "a"), (3, 60, "b"))
    run()
    arrive(spark, folder, (4, 30, "a"), (5, 61, "b"))
    run()
    out = stream.latest_update(spark, f"{folder}/out", ["window_start", "kind"], "n_events")
    assert rows(out, "kind", "n_events") == [("a", 3), ("b", 2)]


def test_ingest_and_scorecard(spark, folder):
    rule = Rule("ODD", lambda: F.col("id") % 2 == 1)
    for batch in ([(1, 0, "a"), (2, 0, "a")], [(3, 1, "a")]):
        arrive(spark, folder, *batch)
        stream.write_ingest(source(spark, folder), f"{folder}/bronze", f"{folder}/c1", "b",
                            "2024-01-01 00:00:00", "feed")
        stream.write_scorecard(source(spark, folder), [rule], f"{folder}/score", f"{folder}/c2")
    got = spark.read.parquet(f"{folder}/bronze").collect()
    assert {(r.id, r.ingestion_batch_id) for r in got} == {(1, "b-0"), (2, "b-0"), (3, "b-1")}
    assert stream.total_scorecard(spark, f"{folder}/score").collect()[0].asDict() \
        == {"n_rows": 3, "odd": 2, "n_clean": 1}


def test_files_read_stay_bounded_over_a_hundred_batches(spark, folder):
    merge = generations.last_values(["k"], "v")
    want, most = {}, 0
    for batch in range(100):
        rows = [(k, batch * 10 + k) for k in range(batch % 4, 8, 4)]
        want.update(rows)
        generations.store(spark.createDataFrame(rows, "k int, v int").coalesce(1), folder, batch)
        if batch % 10 == 9:
            generations.compact(spark, folder, batch, merge)
        if batch % 9 == 8:
            got = generations.current(spark, folder, merge)
            most = max(most, len(got.inputFiles()))
            assert {r.k: r.v for r in got.collect()} == want
    assert most <= 20
    assert spark.read.parquet(f"{folder}/batches").select("batch").distinct().count() <= 20


def test_a_batch_that_runs_again_counts_once(spark, folder):
    def add(batch, n):
        generations.store(spark.createDataFrame([(n,)], "n long"), folder, batch)

    for batch in range(4):
        add(batch, 10 ** batch)
        if batch % 2:
            generations.compact(spark, folder, batch, generations.sums)
    for _ in range(2):  # the merge, or what comes after it, failed: the batch runs again
        add(3, 1000)
        generations.compact(spark, folder, 3, generations.sums)
    assert generations.current(spark, folder, generations.sums).first().n == 1111
    add(4, 5)
    add(4, 7)
    assert generations.current(spark, folder, generations.sums).first().n == 1118


def test_latest_rows_as_in_a_batch(spark, folder, rows):
    draw = __import__("random").Random(5)
    parts = [[(draw.choice([None, 1, 2, 3, 4, 5]), draw.choice([None, 1, 2, 3]), draw.choice([None, "a", "b"]), batch)
              for _ in range(6)] for batch in range(7)]
    schema = "k int, t int, x string, n int"
    merge = generations.latest_rows(["k"], ["t"])
    for batch, part in enumerate(parts):
        df = spark.createDataFrame(part, schema)
        generations.store(df, folder, batch)
        if batch % 2:
            generations.compact(spark, folder, batch, merge, ["k"], 8)
        so_far = spark.createDataFrame([r for p in parts[:batch + 1] for r in p], schema)
        got = generations.current(spark, folder, merge, ["k"])
        assert rows(got) == rows(dedup.latest_by_key(so_far, ["k"], ["t"]))
    # A new session does not know the table; only new rows move to the buckets.
    for t in spark.catalog.listTables():
        if t.name.startswith("generation_"):
            spark.sql(f"drop table {t.name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = generations.current(spark, folder, merge, ["k"])
        assert rows(got) == rows(dedup.latest_by_key(so_far, ["k"], ["t"]))
        assert "Bucketed: true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 2 ** 20))
