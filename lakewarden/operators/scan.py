"""Ordered scans within a key that do not put a whole key into one task.

A plain window sends all rows of a key to one task.  Here the rows are partitioned
by ranges of key and order, which Spark cuts from a sample so that the partitions
are about equal, and stored with the number of their partition.  A partition of a
key is a chunk: however the rows are spread over keys and times, a chunk is at most
one partition, and more partitions make smaller chunks.  Every chunk is summarised
by a partial aggregation, and the few summaries, at most one a partition, are
scanned per key.  What the chunks before add up to is put in front of each chunk as
a row of its own, so one window over the chunk gives the result.

The rows are stored because ranges cut anew, when lost tasks run again, might
differ; rows with the same key and order share a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.session import work_folder


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column,
             partitions: int | None) -> DataFrame:
    """The rows, stored, with their key and chunk in one struct, in which NULL keys are equal."""
    spark = df.sparkSession
    folder = work_folder(spark, "scan")
    valued = df.withColumn("_value", value)
    ranges = [*[F.col(k) for k in keys], *order]
    ranged = (valued.repartitionByRange(partitions, *ranges) if partitions
              else valued.repartitionByRange(*ranges))
    chunk = F.spark_partition_id().alias("_chunk")
    ranged.withColumn("_part", F.struct(*[F.col(k) for k in keys], chunk)).write.parquet(folder)
    return spark.read.parquet(folder)


def _with_carry(rows: DataFrame, keys: Sequence[str], summary: Column,
                carried: Column) -> DataFrame:
    """The rows and, in front of each chunk, a row with the value of the chunks before it."""
    over_chunks = (Window.partitionBy(*[F.col(f"_part.{k}") for k in keys])
                   .orderBy("_part._chunk").rowsBetween(Window.unboundedPreceding, -1))
    before = (rows.groupBy("_part").agg(summary.alias("_sum"))
              .select("_part", carried.over(over_chunks).alias("_value"))
              .filter(F.col("_value").isNotNull()))
    return (rows.withColumn("_real", F.lit(True))
            .unionByName(before.withColumn("_real", F.lit(False)), allowMissingColumns=True))


def _scanned(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return (rows.withColumn(name, value).filter("_real").drop("_part", "_value", "_real"))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                name: str, partitions: int | None = None) -> DataFrame:
    """Add ``name``: the largest non-NULL ``value`` over the rows before this one.

    ``order`` must be a total order within a key.  The number of ``partitions`` is
    the session's unless given.
    """
    rows = _chunked(df, keys, [F.col(c) for c in order], value, partitions)
    both = _with_carry(rows, keys, F.max("_value"), F.max("_sum"))
    so_far = (Window.partitionBy("_part").orderBy("_real", *order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return _scanned(both, name, F.max("_value").over(so_far))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str,
                partitions: int | None = None) -> DataFrame:
    """Add ``name``: 1, 2, 3 ... within each key along ``order``."""
    rows = _chunked(df, keys, order, F.lit(1).cast("bigint"), partitions)
    both = _with_carry(rows, keys, F.sum("_value"), F.sum("_sum"))
    up_to = (Window.partitionBy("_part").orderBy("_real", *order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _scanned(both, name, F.sum("_value").over(up_to))
