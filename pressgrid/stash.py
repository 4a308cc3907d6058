"""Written intermediate tables: cut the lineage, and end with their last reader."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pressgrid.session import drop_folder, run_folder

# Drops the shuffle files of a finished execution; its rows are then in a written table.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stash(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` once to the folder all executors share, and return the reread table.

    Cuts the lineage: nothing above it runs twice, and a lost executor costs no more than its tasks.
    """
    spark = frame.sparkSession
    folder = run_folder(spark, name)
    if _SCOPE.get() is not None:
        _SCOPE.get().append(folder)
    with _shuffles_end_with_the_write(spark):
        frame.write.option("compression", "zstd").parquet(folder)
    table = spark.read.schema(_nullable(frame.schema)).parquet(folder)
    table.stash_folder = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables whose last reader is written."""
    for table in tables:
        drop_folder(table.sparkSession, table.stash_folder)


# Folders of the innermost open scope.
_SCOPE: ContextVar[list[str] | None] = ContextVar("stash_scope", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stashed inside end with the block; the function it gives stashes one that stays.

    A table that stays belongs to the scope around, if there is one.
    """
    outer, own = _SCOPE.get(), []

    def keep(frame: DataFrame, name: str) -> DataFrame:
        token = _SCOPE.set(outer)
        try:
            return stash(frame, name)
        finally:
            _SCOPE.reset(token)

    token = _SCOPE.set(own)
    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for folder in own:
            drop_folder(spark, folder)


def _nullable(schema: StructType) -> StructType:
    return StructType.fromJson({"type": "struct", "fields": [f | {"nullable": True} for f in schema.jsonValue()["fields"]]})
