"""Tables that streams write, so that a repeated micro-batch leaves the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pressgrid.session import drop_folder, folder_done, subfolders
from pressgrid.sources.sinks import overwrite_partitions

BUCKETS = 64


class KeyedTable:
    """Target of upserts with one row per key, in buckets by the key's hash; a batch rewrites the buckets it touches.

    The new buckets are written beside the table first and then replace the old ones.  A batch that is repeated after
    a failure takes the finished ones again, so its result does not depend on how far the failed one came.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, pk: str, buckets: int = BUCKETS):
        self.path, self.schema, self.pk, self.buckets = path, schema, pk, buckets
        if not folder_done(spark, path):
            overwrite_partitions(self._bucketed(spark.createDataFrame([], schema)), path, "bucket")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.pk), F.lit(self.buckets)).cast("int"))

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop("bucket")

    def upsert(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the touched buckets by ``merge(their rows, batch)``."""
        spark = batch.sparkSession
        staged = f"{self.path}-staged/{batch_id}"
        if not folder_done(spark, staged):
            touched = [r.bucket for r in self._bucketed(batch).select("bucket").distinct().collect()]  # at most ``buckets``
            current = self._stored(spark).where(F.col("bucket").isin(touched)).drop("bucket")
            merged = self._bucketed(merge(current, batch)).repartition("bucket")
            merged.write.mode("overwrite").partitionBy("bucket").parquet(staged)
        if subfolders(spark, staged):
            fields = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
            overwrite_partitions(spark.read.schema(fields).parquet(staged), self.path, "bucket")
        drop_folder(spark, f"{self.path}-staged/{batch_id - 1}")


class DayTable:
    """Rows by day and micro-batch; days that are no longer asked for go."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.path = path
        self.fields = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.IntegerType())])
        if not folder_done(spark, path):
            overwrite_partitions(spark.createDataFrame([], self.fields), path, "day", "batch")

    def since(self, spark: SparkSession, day: Column, batch_id: int) -> DataFrame:
        """Rows of the days from ``day`` on that batches before ``batch_id`` wrote; other folders are not read."""
        rows = spark.read.schema(self.fields).parquet(self.path)
        return rows.where((F.col("day") >= day) & (F.col("batch") < batch_id)).drop("day", "batch")

    def append(self, rows: DataFrame, day: Column, batch_id: int) -> None:
        overwrite_partitions(rows.withColumn("day", day).withColumn("batch", F.lit(batch_id)), self.path, "day", "batch")

    def drop_before(self, spark: SparkSession, day: str) -> None:
        """Drop the days before ``day`` (yyyy-MM-dd)."""
        for name in subfolders(spark, self.path):
            if name.startswith("day=") and name[4:] < day:
                drop_folder(spark, f"{self.path}/{name}")


class ResultTable:
    """Rows of each micro-batch in a folder of its own."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.path = path
        self.fields = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
        if not folder_done(spark, path):
            overwrite_partitions(spark.createDataFrame([], self.fields), path, "batch")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.fields).parquet(self.path)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        overwrite_partitions(rows.withColumn("batch", F.lit(batch_id)), self.path, "batch")
