"""Readers: typed CSV, JSON documents, JSON lines, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden import fixed
from lakewarden.session import stored

INCIDENT_SCHEMA = """
    incident_id string, pipeline_name string, severity string, status string, detected_at string,
    error_type string, error_message string, affected_assets array<string>,
    evidence array<struct<type: string, expected_columns: array<string>,
        actual_columns: array<string>, unexpected_columns: array<string>,
        missing_columns: array<string>>>,
    root_cause string
"""

EVENT_SCHEMA = """
    event_id string, incident_id string, timestamp timestamp, actor string, action string,
    status string, details map<string, string>
"""

CONTRACT_SCHEMA = """
    pipeline string, source string, expected_columns array<string>, allow_new_columns boolean
"""


def read_csv(spark: SparkSession, path: str, schema: str = fixed.RAW_CUSTOMER_SCHEMA,
             corrupt: str = "_corrupt_record") -> DataFrame:
    """CSV with header and a declared schema.

    Nothing is inferred, so codes keep their leading zeros; rows that do not
    parse are kept with their text in ``corrupt``.
    """
    return (spark.read.schema(f"{schema}, {corrupt} string")
            .option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt).csv(path))


CORRUPT = "_corrupt_record"


def _read_json(spark: SparkSession, folder: str, schema: str, corrupt: str, pattern: str,
               whole_files: bool = False) -> DataFrame:
    return (spark.read.schema(f"{schema}, {corrupt} string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", corrupt).option("multiLine", whole_files)
            .option("pathGlobFilter", pattern).json(folder)
            .withColumn("source_file", F.col("_metadata.file_name")))


def read_incidents(spark: SparkSession, folder: str, one_per_file: bool = True,
                   corrupt: str = CORRUPT, pattern: str = "*.json") -> DataFrame:
    """Incident documents: one JSON object per file, or one per line.

    What does not parse is a row of NULLs with its text in ``corrupt``; see ``split_corrupt``.
    """
    return _read_json(spark, folder, INCIDENT_SCHEMA, corrupt, pattern, one_per_file)


def read_events(spark: SparkSession, folder: str, corrupt: str = CORRUPT, pattern: str = "*.json") -> DataFrame:
    """Audit events from JSON lines; blank lines are skipped, broken ones kept in ``corrupt``."""
    return _read_json(spark, folder, f"{EVENT_SCHEMA}, event_date date", corrupt, pattern)


def split_corrupt(rows: DataFrame, corrupt: str = CORRUPT) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and a side table of those that did not: ``source_file`` and ``text``.

    The rows are stored once as parsed: a reader of single columns would parse those
    only, and take a record for sound whose others are not.
    """
    rows = stored(rows, "parsed")
    good = rows.filter(F.col(corrupt).isNull()).drop(corrupt)
    bad = rows.filter(F.col(corrupt).isNotNull()).select("source_file", F.col(corrupt).alias("text"))
    return good, bad


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """A contract document as one row per expected column."""
    document = spark.read.schema(CONTRACT_SCHEMA).option("multiLine", True).json(path)
    return document.select(
        F.col("source").alias("table"), "allow_new_columns",
        F.posexplode("expected_columns").alias("position", "column"))
