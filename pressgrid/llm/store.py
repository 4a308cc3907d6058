"""The operators' input tables, and joins that stand a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.session import prepare
from pressgrid.stash import discard, passing_tables, stash  # noqa: F401


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def let(value, body):
    """Column ``body(value)`` that computes ``value`` once however often the body names it."""
    return F.transform(F.array(value), body)[0]


HOT_SHARE = 1000


def join_grouped(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Join each row with its group's row, where ``size`` is the number of rows a group has.

    Groups with over 1/1000 of the ``total`` rows number under 1000 whatever the table, so they are broadcast and their
    rows stay where they are; no key of the shuffled rest holds more than 1/1000 of the rows.
    """
    hot = F.col(size) * HOT_SHARE > total
    few = F.broadcast(groups.where(hot))
    rest = rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(groups.where(~hot), keys))
