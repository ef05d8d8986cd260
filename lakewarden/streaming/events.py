"""Streaming forms of ingestion, deduplication, counting and quality marks.

Functions that take a streaming DataFrame return one; ``write_*`` run it until
all available input is read.  Outputs written per micro-batch go to a folder
named after the batch and replace it, so a batch that is run again after a
failure leaves its rows once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from lakewarden.operators import dedup, rules
from lakewarden.operators.rules import Rule
from lakewarden.plans import medallion
from lakewarden.streaming import generations


def read_files(spark: SparkSession, folder: str, schema: StructType | str,
               files_per_batch: int | None = None) -> DataFrame:
    """A folder in which Parquet files arrive; all new files make one micro-batch
    unless their number is bounded."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def utc(column: str) -> Column:
    """Event time as a timestamp; a watermark cannot be set on one without zone."""
    return F.col(column).cast("timestamp")


# Streaming DataFrames ---------------------------------------------------------

def deduplicated(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First row per key; copies within ``delay`` are dropped, and so are later ones, as late.

    State is kept for ``delay`` only.  Behind ``write_split`` nothing is late here.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def window_counts(stream: DataFrame, time: str, width: str, by: Sequence[str],
                  delay: str) -> DataFrame:
    """Rows per tumbling window and group."""
    return (stream.withWatermark(time, delay).groupBy(F.window(time, width), *by)
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(F.col("window.start").alias("window_start"), *by, "n_events"))


# Writers ----------------------------------------------------------------------

def _run(writer, checkpoint: str) -> StreamingQuery:
    query = (writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def write_append(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows as Parquet, exactly once."""
    return _run(stream.writeStream.format("parquet").outputMode("append")
                .option("path", folder), checkpoint)


def write_ingest(stream: DataFrame, folder: str, checkpoint: str, batch_prefix: str,
                 ingested_at: str, source: str) -> StreamingQuery:
    """Bronze ingestion: every micro-batch is a batch of its own."""

    def write(rows: DataFrame, batch: int) -> None:
        (medallion.bronze(rows, f"{batch_prefix}-{batch}", ingested_at, source)
         .write.mode("overwrite").parquet(f"{folder}/batch={batch}"))

    return _run(stream.writeStream.foreachBatch(write), checkpoint)


def _write_merged(stream: DataFrame, folder: str, checkpoint: str, mode: str, reduced: Callable[[DataFrame], DataFrame],
                  merge: generations.Merge, every: int, keys: Sequence[str] = (), buckets: int = 0) -> StreamingQuery:
    """Store what each micro-batch comes to, and merge it into a generation after every so many."""

    def write(rows: DataFrame, batch: int) -> None:
        generations.store(reduced(rows), folder, batch)
        if (batch + 1) % every == 0:
            generations.compact(rows.sparkSession, folder, batch, merge, keys, buckets)

    return _run(stream.writeStream.outputMode(mode).foreachBatch(write), checkpoint)


def write_updates(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], value: str,
                  every: int = 10) -> StreamingQuery:
    """Changed result rows of every micro-batch, merged to the last value per key."""
    return _write_merged(stream, folder, checkpoint, "update", lambda rows: rows,
                         generations.last_values(keys, value), every)


def latest_update(spark: SparkSession, folder: str, keys: Sequence[str], value: str) -> DataFrame:
    """The present result behind ``write_updates``: the value of the last batch per key."""
    return generations.current(spark, folder, generations.last_values(keys, value)).drop("batch")


def write_scorecard(stream: DataFrame, row_rules: Sequence[Rule], folder: str,
                    checkpoint: str, every: int = 10) -> StreamingQuery:
    """Broken-rule counts of every micro-batch, merged to their sums."""

    def counted(rows: DataFrame) -> DataFrame:
        marked = rules.evaluate(rows, row_rules)
        clean = F.size(rules.flags(row_rules)) == 0
        return marked.agg(F.count(F.lit(1)).alias("n_rows"), *rules.broken_counts(marked, row_rules),
                          F.count_if(clean).alias("n_clean"))

    return _write_merged(stream, folder, checkpoint, "append", counted, generations.sums, every)


def total_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over all micro-batches so far."""
    return generations.current(spark, folder, generations.sums)


def write_latest(stream: DataFrame, keys: Sequence[str], latest: Sequence[str], folder: str, checkpoint: str,
                 every: int = 10, buckets: int = 64) -> StreamingQuery:
    """The latest row per key of everything that ever came, in whatever order, as batch deduplication keeps it.

    Unlike ``deduplicated`` no row is too late; there is no state but the stored rows.
    With at least as many ``buckets`` as shuffle partitions, only new rows move in a merge.
    """
    return _write_merged(stream, folder, checkpoint, "append", lambda rows: dedup.latest_by_key(rows, keys, latest),
                         generations.latest_rows(keys, latest), every, keys, buckets)


def read_latest(spark: SparkSession, folder: str, keys: Sequence[str], latest: Sequence[str]) -> DataFrame:
    """The present rows behind ``write_latest``."""
    return generations.current(spark, folder, generations.latest_rows(keys, latest), keys)


# Late rows ----------------------------------------------------------------------

def write_split(stream: DataFrame, time: str, delay: str, folder: str, checkpoint: str,
                width: str | None = None) -> StreamingQuery:
    """Store the rows of every micro-batch with a column ``late``, so that none is lost.

    A row is late if its time lies ``delay`` or more behind the latest time of the
    batches before it: the bound of a watermark, but taken from the data.  With a
    window ``width`` the end of the row's tumbling window counts instead of its time,
    and a row without a time, which no window holds, is set aside with the late ones;
    otherwise it is kept.  Beside the rows, each batch stores the latest time so far
    in ``<folder>/marks``, which the next batch reads.  Both are replaced when the
    batch runs again.
    """
    spark = stream.sparkSession
    rows_in, marks_in = f"{folder}/rows", f"{folder}/marks"

    def marked(rows: DataFrame, bound: Column) -> DataFrame:
        if not width:
            return rows.withColumn("late", F.coalesce(F.col(time) <= bound, F.lit(False)))
        # The window function drops rows without a time; those take another way.
        ends = rows.withColumn("_end", F.window(time, width)["end"])
        late = ends.withColumn("late", F.coalesce(F.col("_end") <= bound, F.lit(False)))
        return late.drop("_end").unionByName(
            rows.filter(F.col(time).isNull()).withColumn("late", F.lit(True)))

    def write(rows: DataFrame, batch: int) -> None:
        seen = (spark.read.schema("mark timestamp").parquet(f"{marks_in}/batch={batch - 1}")
                .first()["mark"] if batch else None)
        bound = F.lit(seen).cast("timestamp") - F.expr(f"interval '{delay}'")
        (marked(rows, bound).write.mode("overwrite").partitionBy("late")
         .parquet(f"{rows_in}/batch={batch}"))
        stored = spark.read.schema(rows.schema).parquet(f"{rows_in}/batch={batch}")
        (stored.agg(F.greatest(F.max(time), F.lit(seen).cast("timestamp")).alias("mark"))
         .write.mode("overwrite").parquet(f"{marks_in}/batch={batch}"))

    return _run(stream.writeStream.foreachBatch(write), checkpoint)


def _split_schema(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("batch", IntegerType()),
                       StructField("late", BooleanType())])


def read_on_time(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows behind ``write_split`` that were not late, as a stream."""
    return (spark.readStream.schema(_split_schema(schema)).parquet(f"{folder}/rows")
            .filter(~F.col("late")).drop("batch", "late"))


def late_rows(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The side table behind ``write_split``: late rows with their ``batch``."""
    return (spark.read.schema(_split_schema(schema)).parquet(f"{folder}/rows")
            .filter("late").drop("late"))


def late_counts(spark: SparkSession, folder: str, schema: StructType, kept: DataFrame,
                keys: Sequence[str]) -> DataFrame:
    """Per micro-batch, its late rows, and how many of their keys ``kept`` does not hold.

    Both are counted from stored rows.
    """
    batches = spark.read.schema(_split_schema(schema)).parquet(f"{folder}/rows")
    late = batches.filter("late").select("batch", *keys)
    lost = (late.distinct().join(kept.select(*keys).distinct(), list(keys), "left_anti")
            .groupBy("batch").agg(F.count(F.lit(1)).alias("new_keys")))
    zero = F.lit(0).cast("bigint")
    return (batches.groupBy("batch").agg(F.count_if("late").alias("late_rows"))
            .join(lost, "batch", "left")
            .select("batch", "late_rows", F.coalesce("new_keys", zero).alias("new_keys")))
