"""Plain output types for results that are compared across engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, times without zone, text lists joined with commas."""
    def one(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        return c.alias(field.name)
    return df.select(*[one(f) for f in df.schema.fields])
