"""Queries that run as streams over files derived from the given tables.

Each call lets its input arrive in a new folder part by part, runs the stream
after each part from its checkpoint, and returns what the stream has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakewarden import fixed
from lakewarden.plans import inputs, medallion
from lakewarden.plans.oracle_inputs import over
from lakewarden.plans.shape import plain
from lakewarden.session import work_folder
from lakewarden.streaming import events as stream

FIRST_DAY, LAST_DAY = "2024-01-02", "2024-01-30"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "events").withColumn("ts", stream.utc("ts"))


def _run_per_arrival(spark: SparkSession, parts: list[DataFrame], purpose: str,
                     start: Callable[[DataFrame, str], StreamingQuery]
                     ) -> tuple[str, list[StreamingQuery]]:
    """Let the parts arrive one after the other, and run the stream after each.

    Every run goes on from the checkpoint of the one before.  ``start`` gets the
    stream and its output folder.
    """
    folder = work_folder(spark, purpose)
    runs = []
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/arrived")
        runs.append(start(stream.read_files(spark, f"{folder}/arrived", part.schema), folder))
    return folder, runs


def _thirds(events: DataFrame) -> list[DataFrame]:
    """The events of the month in three parts, by time; those without a time come last."""
    cuts = [F.lit(d).cast("timestamp") for d in ("2024-01-11", "2024-01-21")]
    return [events.filter(F.col("ts") < cuts[0]),
            events.filter((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])),
            events.filter((F.col("ts") >= cuts[1]) | F.col("ts").isNull())]


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that arrived since the last run becomes a bronze batch."""
    folder, _ = _run_per_arrival(
        spark, _thirds(_events(spark, sf_dir)), "ingest",
        lambda arriving, to: stream.write_ingest(arriving, f"{to}/rows", f"{to}/checkpoint",
                                                 "batch", inputs.INGESTED_AT, "events"))
    return plain(spark.read.parquet(f"{folder}/rows").drop("batch"))


def _resent(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The events, and then those of the first and the last day once more."""
    events = _events(spark, sf_dir)
    again = events.filter((F.col("ts") < F.lit(FIRST_DAY).cast("timestamp"))
                          | (F.col("ts") >= F.lit(LAST_DAY).cast("timestamp")))
    return [*_thirds(events), again]


def _held_back(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """As ``_resent``, but the first day's errors arrive with the last part only."""
    held = F.coalesce((F.col("ts") < F.lit(FIRST_DAY).cast("timestamp"))
                      & (F.col("event_type") == "error"), F.lit(False))
    first, *later = _resent(spark, sf_dir)
    return [first.filter(~held), *later]


def _deduplicate(arriving: DataFrame, to: str) -> StreamingQuery:
    stream.write_split(arriving, "ts", "2 days", to, f"{to}/split")
    on_time = stream.read_on_time(arriving.sparkSession, to, arriving.schema)
    return stream.write_append(stream.deduplicated(on_time, ["event_id"], "ts", "2 days"),
                               f"{to}/kept", f"{to}/checkpoint")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent again are dropped: recent ones as copies, old ones go to a side table."""
    folder, _ = _run_per_arrival(spark, _resent(spark, sf_dir), "dedup", _deduplicate)
    return plain(spark.read.parquet(f"{folder}/kept"))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that came later than allowed, per micro-batch, and those never seen in time."""
    schema = _events(spark, sf_dir).schema
    folder, _ = _run_per_arrival(spark, _held_back(spark, sf_dir), "late", _deduplicate)
    kept = spark.read.parquet(f"{folder}/kept")
    return stream.late_counts(spark, folder, schema, kept, ["event_id"])


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit events per day and action, kept up to date while they arrive."""
    def count(arriving: DataFrame, to: str) -> StreamingQuery:
        stream.write_split(arriving, "ts", "3 days", to, f"{to}/split", "1 day")
        on_time = stream.read_on_time(spark, to, arriving.schema)
        counted = stream.window_counts(on_time, "ts", "1 day", ["action"], "3 days")
        return stream.write_updates(counted, f"{to}/counts", f"{to}/checkpoint", ["window_start", "action"], "n_events",
                                    every=4)

    folder, _ = _run_per_arrival(spark, _thirds(inputs.audit_events(spark, sf_dir)), "windows",
                                 count)
    return plain(stream.latest_update(spark, f"{folder}/counts", ["window_start", "action"],
                                      "n_events"))


def stream_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken customer rules counted per run, and added up."""
    feed = inputs.customer_feed(spark, sf_dir)
    sent = [feed.filter(F.col("data_source_system") == s)
            for s in ("CRM_LEGACY", "CRM_NEW", "POS")]
    folder, _ = _run_per_arrival(
        spark, sent, "score",
        lambda arriving, to: stream.write_scorecard(arriving, medallion.customer_rules(),
                                                    f"{to}/counts", f"{to}/checkpoint", every=2))
    return stream.total_scorecard(spark, f"{folder}/counts")


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer master kept up to date while new, stale and repeated rows arrive."""
    feed = inputs.customer_feed(spark, sf_dir)
    sent = [feed.filter(F.col("data_source_system") == s) for s in ("CRM_NEW", "CRM_LEGACY", "POS", "CRM_NEW")]
    # The legacy system's rows are older than what has come before; then a part of it all comes again.
    sent[3] = sent[3].filter(F.col("customer_id") % 3 == 0)
    key, latest = ["customer_id"], ["last_updated_at"]
    folder, _ = _run_per_arrival(
        spark, sent, "latest",
        lambda arriving, to: stream.write_latest(arriving, key, latest, f"{to}/rows", f"{to}/checkpoint", every=2,
                                                 buckets=8))
    return plain(stream.read_latest(spark, f"{folder}/rows", key, latest).select(
        "customer_id", "customer_name", "email", "country", "status", "last_updated_at", "data_source_system"))


QUERIES = {
    "stream_latest": stream_latest,
    "stream_ingest": stream_ingest,
    "stream_dedup": stream_dedup,
    "stream_late": stream_late,
    "stream_window_counts": stream_window_counts,
    "stream_scorecard": stream_scorecard,
}


# Oracles ------------------------------------------------------------------------

_RULE_COLUMNS = {
    fixed.FLAG_INVALID_EMAIL: r"not coalesce(regexp_matches(email, "
                              r"'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'), false)",
    fixed.FLAG_NEGATIVE_REVENUE: "total_revenue_cents < 0",
    fixed.FLAG_CHURN_RANGE: "churn_risk_score not between 0 and 100",
    fixed.FLAG_AOV_MISMATCH: "total_orders > 0 and 10 * abs(avg_order_value_cents * total_orders "
                             "- greatest(total_revenue_cents, 0)) > "
                             "greatest(total_revenue_cents, 0)",
}

ORACLES = {
    "stream_latest": over("deduplicated", """
        select customer_id, customer_name, email, country, status, last_updated_at, data_source_system
        from deduplicated"""),
    "stream_ingest": """
        select *, timestamp '2002-01-01' as ingestion_timestamp, 'events' as source_file_name,
          case when ts < timestamp '2024-01-11' then 'batch-0'
            when ts < timestamp '2024-01-21' then 'batch-1' else 'batch-2' end
            as ingestion_batch_id
        from events""",
    "stream_dedup": "select * from events",
    "stream_late": f"""
        select batch::int as batch, case when batch = 3 then n else 0 end as late_rows,
          case when batch = 3 then held else 0 end as new_keys
        from (select count(*) as n, count(*) filter (where event_type = 'error') as held
              from events where ts < timestamp '{FIRST_DAY}'),
          (values (0), (1), (2), (3)) t(batch)""",
    "stream_window_counts": over("audit_events", """
        select date_trunc('day', ts) as window_start, action, count(*) as n_events
        from audit_events group by all"""),
    "stream_scorecard": over("raw_customers", """
        select count(*) as n_rows, {}, count(*) filter (where not coalesce({}, false)) as n_clean
        from raw_customers""".format(
        ", ".join(f"count(*) filter (where {c}) as {n.lower()}" for n, c in _RULE_COLUMNS.items()),
        " or ".join(f"coalesce({c}, false)" for c in _RULE_COLUMNS.values()))),
}
