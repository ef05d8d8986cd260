"""Results of streams kept current, at a bounded cost for readers.

Each micro-batch leaves its rows in a folder of its own.  Every so many batches what has
come since is merged with the last generation into a new one, and then a pointer is
written, in one of two slots in turn, so that one of them is whole at any time.  Readers
take the newest generation and the batches after it.  A batch that runs again replaces
its rows, and its merge starts from the generation before it, so nothing counts twice.
What only older generations were made of is deleted.

A merge is a function of the generation's rows (None at first) and the rows of later
batches, which have their ``batch``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.operators import dedup

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]
POINTER = "slot int, generation int, buckets int"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of whatever store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _pointers(spark: SparkSession, folder: str) -> list[tuple[int, int, int]]:
    """(generation, slot, buckets), the newest first; there are at most two."""
    slots = _read(spark, f"{folder}/pointer", POINTER)
    return sorted(((r.generation, r.slot, r.buckets) for r in slots.collect()), reverse=True) if slots else []


def _table(folder: str, generation: int) -> str:
    return f"generation_{sha256(folder.encode()).hexdigest()[:16]}_{generation}"


def _generation(spark: SparkSession, folder: str, generation: int, buckets: int, keys: Sequence[str]) -> DataFrame:
    """The rows of a generation; a bucketed one is read through a table, so that its buckets are known."""
    path, name = f"{folder}/generations/{generation}", _table(folder, generation)
    rows = spark.read.parquet(path)
    if not buckets:
        return rows
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by "
                  f"({', '.join(f'`{k}`' for k in keys)}) into {buckets} buckets location '{path}'")
    return spark.table(name)


def store(rows: DataFrame, folder: str, batch: int) -> None:
    """The rows of a micro-batch; those of an earlier run of it are replaced."""
    rows.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch}")


def _since(spark: SparkSession, folder: str, low: int, high: int | None) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/batches").filter(F.col("batch") > low)
    return rows if high is None else rows.filter(F.col("batch") <= high)


def compact(spark: SparkSession, folder: str, batch: int, merge: Merge, keys: Sequence[str] = (),
            buckets: int = 0) -> None:
    """Make the generation up to a batch.  With ``buckets`` it is stored in buckets of its keys."""
    known = _pointers(spark, folder)
    earlier = [p for p in known if p[0] < batch]
    base = earlier[0] if earlier else None
    rows = merge(_generation(spark, folder, base[0], base[2], keys) if base else None,
                 _since(spark, folder, base[0] if base else -1, batch))
    path, name = f"{folder}/generations/{batch}", _table(folder, batch)
    if buckets:
        spark.sql(f"drop table if exists {name}")
        _delete(spark, path)
        rows.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    else:
        rows.write.mode("overwrite").parquet(path)
    slot = 1 - base[1] if base else 0
    spark.createDataFrame([(batch, buckets)], "generation int, buckets int").coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/pointer/slot={slot}")
    # The generation before stays for readers that hold it, and so do the batches behind that.
    for generation, _, old in earlier[1:]:
        if old:
            spark.sql(f"drop table if exists {_table(folder, generation)}")
        _delete(spark, f"{folder}/generations/{generation}")
    if base:
        done = spark.read.parquet(f"{folder}/batches").filter(F.col("batch") <= base[0]).select("batch").distinct()
        for row in done.collect():
            _delete(spark, f"{folder}/batches/batch={row.batch}")


def current(spark: SparkSession, folder: str, merge: Merge, keys: Sequence[str] = ()) -> DataFrame:
    """The present result: the newest generation and the batches since."""
    known = _pointers(spark, folder)
    if not known:
        return merge(None, _since(spark, folder, -1, None))
    generation, _, buckets = known[0]
    return merge(_generation(spark, folder, generation, buckets, keys), _since(spark, folder, generation, None))


# Merges -------------------------------------------------------------------------

def sums(base: DataFrame | None, new: DataFrame) -> DataFrame:
    """All columns added up."""
    rows = new.drop("batch")
    rows = rows if base is None else base.unionByName(rows)
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def last_values(keys: Sequence[str], value: str) -> Merge:
    """The value of the last batch per key, with that ``batch``."""
    def merge(base: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new.select(*keys, value, "batch")
        rows = rows if base is None else base.unionByName(rows)
        return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value), F.max("batch").alias("batch"))
    return merge


def latest_rows(keys: Sequence[str], latest: Sequence[str]) -> Merge:
    """The row per key that ``dedup.latest_by_key`` keeps of all rows that ever came.

    New rows are reduced to one per key first and joined with the generation on the key,
    which is unique on both sides; a generation in buckets of the key does not move.
    """
    def merge(base: DataFrame | None, new: DataFrame) -> DataFrame:
        best = dedup.latest_by_key(new.drop("batch"), keys, latest)
        if base is None:
            return best
        rest = [c for c in dedup.orderable(best) if c not in {*keys, *latest}]
        old, now = base.select(F.struct("*").alias("old"), *keys), best.select(F.struct("*").alias("now"), *keys)

        def before(column: str, falling: bool, otherwise: Column) -> Column:
            a, b = F.col(f"old.{column}"), F.col(f"now.{column}")
            return F.when(a.eqNullSafe(b), otherwise).otherwise(F.coalesce(a > b if falling else a < b, a.isNotNull()))

        order = [*((c, True) for c in latest), *((c, False) for c in rest)]
        keeps = reduce(lambda rule, c: before(*c, rule), reversed(order), F.lit(True))
        picked = F.when(F.col("now").isNull(), F.col("old")).when(F.col("old").isNull(), F.col("now")).when(
            keeps, F.col("old")).otherwise(F.col("now"))
        return old.join(now, list(keys), "full").select(picked.alias("row")).select("row.*")
    return merge
