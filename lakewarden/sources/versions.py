"""Several tables published at once.

All tables of a version are written to a folder of their own, then a manifest that names
them, in one of two slots in turn, so that one slot is whole at any time.  Readers go by
the manifest of the highest version: until it is written, they see the version before,
and never a mix.  A run that ended half way leaves files that nothing names.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "slot int, version int, name string, path string"


def _manifests(spark: SparkSession, root: str) -> list:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{root}/manifest").collect()  # one row per table, two versions
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def latest(spark: SparkSession, root: str) -> tuple[int, dict[str, str]]:
    """The number of the published version, 0 before the first, and the path of each of its tables."""
    rows = _manifests(spark, root)
    version = max((r.version for r in rows), default=0)
    return version, {r.name: r.path for r in rows if r.version == version}


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> int:
    """Write a new version of all tables; returns its number.  There is one publisher at a time."""
    rows = _manifests(spark, root)
    version, _ = latest(spark, root)
    folder = f"{root}/versions/{version + 1}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}")
    taken = {r.slot for r in rows if r.version == version}
    slot = 1 if 0 in taken else 0
    entries = [(version + 1, name, f"{folder}/{name}") for name in tables]
    spark.createDataFrame(entries, "version int, name string, path string").coalesce(1).write.mode(
        "overwrite").parquet(f"{root}/manifest/slot={slot}")
    return version + 1


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the published version."""
    return spark.read.parquet(latest(spark, root)[1][name])
