"""Writers: whole-table Parquet, appended events, one-record JSON, staged publish."""

from __future__ import annotations

import re
import warnings
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.session import dealt
from lakewarden.sources import versions

# JSON times are written to the millisecond unless a format says otherwise.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def overwrite_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_events(events: DataFrame, folder: str) -> None:
    """Append audit events as JSON lines, one folder per day.

    Days bound the number of folders and files however many incidents there are.
    """
    (events.withColumn("event_date", F.to_date("timestamp"))
     .write.mode("append").option("timestampFormat", MICROS)
     .partitionBy("event_date").json(folder))


def quarantine_events(events: DataFrame, folder: str) -> None:
    """Keep refused events beside the log, with ``invalid``: what is wrong with them."""
    events.write.mode("append").option("timestampFormat", MICROS).json(f"{folder}-quarantine")


def write_record(one_row: DataFrame, folder: str) -> None:
    """A single record, such as a scorecard, as one JSON file."""
    one_row.coalesce(1).write.mode("overwrite").json(folder)


def write_documents(rows: DataFrame, folder: str) -> None:
    """Each row as a JSON document in a file of its own.

    A file costs much more than its bytes, so the rows are dealt out; and each task moves
    its own files to the folder, which the driver would otherwise do one by one.
    """
    (dealt(rows).write.option("maxRecordsPerFile", 1)
     .option("mapreduce.fileoutputcommitter.algorithm.version", 2).json(folder))


def copy_record(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a single JSON record; warns and returns False when there is none."""
    try:
        record = spark.read.text(source)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no record at {source}", stacklevel=2)
        return False
    record.coalesce(1).write.mode("overwrite").text(target)
    return True


def published(spark: SparkSession, registry: str) -> DataFrame:
    """What has been published so far: incident_id, strategy_id, target."""
    schema = "incident_id string, strategy_id string, target string"
    try:
        return spark.read.schema(schema).json(registry)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def publish(spark: SparkSession, incident_id: str, strategy_id: str, gate: DataFrame,
            tables: Mapping[str, str], staging: str, registry: str) -> str:
    """Copy rebuilt tables into a staged area, once per incident and strategy.

    ``gate`` is the publish gate's output.  Returns ALREADY_PUBLISHED, the first
    failing reason, or PUBLISHED.  The tables become visible together, as a version
    under the target (see ``versions``), and the registry entry is written last, so a
    run that was cut short is repeated as another version; the source tables are never
    touched.  Ids become part of a path, so ids with other than letters, digits,
    hyphens and underscores are refused.
    """
    for value in (incident_id, strategy_id):
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", str(value)):
            raise ValueError(f"not an id: {value!r}")
    mine = (F.col("incident_id") == incident_id) & (F.col("strategy_id") == strategy_id)
    if not published(spark, registry).filter(mine).isEmpty():
        return "ALREADY_PUBLISHED"
    decision = gate.filter(mine).select("publish_allowed", "reason").take(1)
    if not decision:
        return "No authorization record found."
    if not decision[0]["publish_allowed"]:
        return decision[0]["reason"]
    target = f"{staging}/executed/{incident_id}/{strategy_id}"
    versions.publish(spark, target, {name: spark.read.parquet(source) for name, source in tables.items()})
    entry = spark.createDataFrame([(incident_id, strategy_id, target)],
                                  "incident_id string, strategy_id string, target string")
    entry.coalesce(1).write.mode("append").json(registry)
    return "PUBLISHED"
