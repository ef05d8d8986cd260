"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import time
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "lakewarden", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution picks partition counts, splits skewed join partitions and
    turns joins into broadcasts only when the measured side is small.  Streaming
    state lives in RocksDB so that it may outgrow executor heap.  Methods above
    8,000 bytes of code are never compiled to machine code by the JVM, so larger
    generated stages fall back to operators that are.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **(extra or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="lakewarden-")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors can reach.

    Only a local session may go without the setting; it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_root()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the shared root; each call gets its own."""
    return f"{checkpoint_root(spark)}/lakewarden/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once to the shared folder and read back.

    For results that several steps share, and for the small side of a join with a key
    that may hold much of the other: behind an aggregation on that key adaptive
    execution cannot split it, behind a scan it can.
    """
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def dealt(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has, whatever their size in bytes.

    For steps that work much on little input, as a small file is otherwise one task's.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sweep(spark: SparkSession, hours: float) -> list[str]:
    """Delete working folders that no job has written to for so many hours; returns their names.

    Results that are still read, lazily, from such a folder are lost with it, so the time
    must be longer than any job's.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_root(spark)}/lakewarden")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    gone = []
    for entry in store.listStatus(root):
        age = time.time() - max([entry.getModificationTime()] + [
            x.getModificationTime() for x in store.listStatus(entry.getPath())]) / 1000
        if age > hours * 3600 and store.delete(entry.getPath(), True):
            gone.append(entry.getPath().getName())
    return sorted(gone)
