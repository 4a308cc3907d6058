"""Result columns of registered queries in types both engines compare exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def report(df: DataFrame) -> DataFrame:
    """Timestamps as text, decimals as double, integers as long, string lists joined by '|'."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.DecimalType):
            column = column.cast("double")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("long")
        elif isinstance(kind, T.FloatType):
            column = column.cast("double")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        columns.append(column.alias(field.name))
    return df.select(*columns)
