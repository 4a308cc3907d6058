"""Writers: tables by partition that a repeated run leaves unchanged, and reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from pressgrid.session import drop_folder, subfolders


def overwrite_partitions(rows: DataFrame, path: str, *parts: str) -> None:
    """Overwrite the partitions that ``rows`` has, and no other."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def write_by_date(rows: DataFrame, path: str, at: Column, part: str = "day") -> None:
    """Write rows under the UTC date of ``at``; dates already stored are replaced, other dates stay.

    Rows without a date go to the partition of null.  One shuffle brings each date together; adaptive execution splits
    a date that is far larger than the others.
    """
    overwrite_partitions(rows.withColumn(part, at.cast("date")).hint("rebalance", part), path, part)


def drop_partitions(spark: SparkSession, path: str, part: str, values: list[str]) -> None:
    """Drop the named partitions, if stored."""
    stored = set(subfolders(spark, path))
    for value in values:
        if f"{part}={value}" in stored:
            drop_folder(spark, f"{path}/{part}={value}")


def write_report(row: DataFrame, path: str) -> None:
    """Write the few rows of a run's report as one JSON file, null fields included."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
