"""Incremental forms of the batch operators, one micro-batch at a time.

A step may be started again and again with the same checkpoint: it takes what has arrived since, and goes on from the
state it left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrid import constants as C
from pressgrid.operators import clustering
from pressgrid.operators.dashboards import since
from pressgrid.stash import passing_tables, stash
from pressgrid.sources import upserts
from pressgrid.streaming import keyed
from pressgrid.streaming.tables import DayTable, KeyedTable, ResultTable

STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
URL_DAYS = 30


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of its files.

    The last letter of the path is written as a pattern: the file source takes
    a plain path for a folder and would refuse a single file.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


@contextmanager
def _keyed_store(spark: SparkSession) -> Iterator[None]:
    """Processors need the store that holds several states per key."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, KEYED_STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run the stream over everything that is there now, then stop."""
    with _keyed_store(stream.sparkSession):
        running = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        running.awaitTermination()


def stream_discover(stream: DataFrame, checkpoint: str, out: ResultTable, known: DataFrame, days: int = URL_DAYS) -> None:
    """New URLs of each batch, the first entry of a URL winning.

    ``known`` holds URLs from before the stream; a URL is forgotten ``days`` of event time after its first entry.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        new = batch.drop("arrival", "fetched_at").withColumns({"processing_state": F.lit("discovered"), "attempt_count": F.lit(0).cast("long")})
        out.append(new, batch_id)

    drain(keyed.first_of_url(stream, known, days), checkpoint, each)


def daily_counts(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Counts per UTC day; rows later than the watermark are dropped."""
    return (
        stream.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "n")
    )


def stream_daily_counts(stream: DataFrame, checkpoint: str, out: KeyedTable, lateness: str, ts: str = "ts") -> None:
    """Events later than ``lateness`` behind the newest one are dropped; none is while the span covers the source's disorder.

    The table has the count of each day; a batch replaces the days it changed."""
    drain(daily_counts(stream, ts, lateness), checkpoint, lambda batch, batch_id: _replace(out, batch, batch_id), mode="update")


def _replace(out: KeyedTable, batch: DataFrame, batch_id: int) -> None:
    """Rows of the batch take the place of the table's rows with their keys."""
    out.upsert(batch, batch_id, lambda current, new: current.join(new.select(out.pk), out.pk, "left_anti").unionByName(new))


def stream_cluster(
    stream: DataFrame, checkpoint: str, store: DayTable, out: ResultTable, as_of: Column,
    lookback_days: int = C.LOOKBACK_DAYS, threshold: float = C.SIMILARITY_THRESHOLD,
) -> None:
    """Stories for each batch of embedded articles, against the clustered articles of the window.

    ``stream`` has (article_id, published_at, embedding).  The store keeps the vectors of the window by day of
    publication with the root article, which is the story key; days before the window go after each batch.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        start = since(as_of, days=lookback_days)
        first_day = spark.range(1).select(F.date_format(start, "yyyy-MM-dd").alias("day")).first().day
        with passing_tables(spark):
            batch = stash(batch.select("article_id", "published_at", "embedding"), "arrived")
            recent = store.since(spark, F.lit(first_day).cast("date"), batch_id).where(F.col("published_at") >= start)
            both = batch.withColumn("story_id", F.lit(None).cast("long")).unionByName(recent)
            assigned = stash(clustering.assign_stories(both, as_of, lookback_days, threshold).select("article_id", "story_id"), "assigned")
            out.append(assigned, batch_id)
            clustered = batch.where(F.col("published_at") >= start).join(assigned, "article_id")
            store.append(clustered, F.to_date("published_at"), batch_id)
            store.drop_before(spark, first_day)

    drain(stream, checkpoint, each)


def stream_latest_wins(stream: DataFrame, checkpoint: str, out: KeyedTable, version: str) -> None:
    """The table holds the row of the highest version of each key after every batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        out.upsert(batch, batch_id, lambda current, new: upserts.latest_wins_upsert(current, new, out.pk, version))

    drain(stream, checkpoint, each)


def stream_attempts(stream: DataFrame, checkpoint: str, out: KeyedTable) -> None:
    """State and failures of each article over a stream of (article_id, at, seq, ok), starting at ``discovered``.

    Outcomes count in the order of their batches, and by (at, seq) inside one.  Outcomes of an article that failed or
    passed the last stage are ignored.  The table is the state: a batch goes on from its rows.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        def merge(current: DataFrame, rows: DataFrame) -> DataFrame:
            new = keyed.advanced(current, rows)
            moved = new.select(F.col("article_id").alias("moved"))
            # Rows without an article are one key.
            return current.join(moved, F.col("article_id").eqNullSafe(F.col("moved")), "left_anti").unionByName(new)

        out.upsert(batch, batch_id, merge)

    drain(stream, checkpoint, each)


def stream_recompare(stream: DataFrame, checkpoint: str, out: ResultTable, comparisons: DataFrame) -> None:
    """Stories touched by a batch that are due for a (new) comparison; all of them, without a limit.

    ``comparisons`` are those from before the stream.
    """
    drain(keyed.due_stories(stream, comparisons), checkpoint, out.append)
