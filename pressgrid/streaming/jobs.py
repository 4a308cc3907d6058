"""Registered streaming queries: the given tables arrive in slices, one run of the stream for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pressgrid.operators import embedding, filters
from pressgrid.plans.tables import Tables, as_of
from pressgrid.session import run_folder
from pressgrid.stash import stash
from pressgrid.streaming import steps
from pressgrid.streaming.tables import DayTable, KeyedTable, ResultTable

SLICES = 3


def arrive(rows: DataFrame, order: Column, folder: str, run: Callable[[DataFrame], None], slices: int = SLICES) -> None:
    """Write ``rows`` in ``slices`` ranges of a whole-number ``order`` and start the stream after each.

    Every row arrives once; each start goes on from the checkpoint of the one before.
    """
    spark = rows.sparkSession
    ends = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, high = (ends.low or 0), (ends.high or 0) + 1
    place = F.least(F.floor((order - low) * slices / (high - low)), F.lit(slices - 1))
    for k in range(slices):
        rows.where(F.coalesce(place, F.lit(0)) == k).write.parquet(f"{folder}/in/{k}")
        run(spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*"))


def query_discover(t: Tables) -> DataFrame:
    """Feed entries stream in with repeated URLs; each URL is discovered once."""
    folder = run_folder(t.spark, "discover")
    entries = Tables.articles_from(t.documents).selectExpr(
        "concat('https://wire.example/', article_id div 3) as url", "headline", "outlet_id", "article_id", "article_id as arrival",
        "timestamp_seconds(1704067200 + article_id) as fetched_at",
    )
    shape = entries.drop("arrival", "fetched_at").selectExpr("*", "'' as processing_state", "cast(0 as bigint) as attempt_count").schema
    found = ResultTable(t.spark, f"{folder}/articles", shape)
    known = t.spark.createDataFrame([], "url string")
    arrive(entries, F.col("arrival"), folder, lambda stream: steps.stream_discover(stream, f"{folder}/checkpoint", found, known))
    return found.read(t.spark).select("url", "headline", "outlet_id", "article_id", "processing_state")


def query_daily_counts(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "daily")
    events = t.given("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    days = KeyedTable(t.spark, f"{folder}/days", T.StructType().add("date", "string").add("n", "long"), "date", buckets=4)
    # The events span one month and come in any order of days.
    arrive(events, F.col("event_id"), folder, lambda stream: steps.stream_daily_counts(stream, f"{folder}/checkpoint", days, "31 days"))
    return days.read(t.spark)


def query_cluster(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "cluster")
    texts = t.articles.select(
        "article_id", "published_at", filters.embed_text_of(F.col("headline"), F.col("full_text")).alias("embed_text")
    )
    # Written once: each slice would compute the vectors again.
    vectors = stash(embedding.hash_embedding(texts, "embed_text").drop("embed_text"), "embedded")
    store = DayTable(t.spark, f"{folder}/clustered", T.StructType([*vectors.schema.fields, T.StructField("story_id", T.LongType())]))
    out = ResultTable(t.spark, f"{folder}/stories", T.StructType().add("article_id", "long").add("story_id", "long"))

    def run(stream: DataFrame) -> None:
        steps.stream_cluster(stream, f"{folder}/checkpoint", store, out, as_of(), lookback_days=31)

    # By time, then id, as the batch operator takes them.
    arrive(vectors, F.unix_micros("published_at"), folder, run)
    return out.read(t.spark).select("article_id", "story_id")


def query_latest_wins(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "latest")
    events = t.given("events").select("user_id", "event_id", "event_type", "value")
    target = KeyedTable(t.spark, f"{folder}/rows", events.schema, "user_id", buckets=8)
    arrive(events, F.col("event_id"), folder, lambda stream: steps.stream_latest_wins(stream, f"{folder}/checkpoint", target, "event_id"))
    return target.read(t.spark)


def query_attempts(t: Tables) -> DataFrame:
    """Users stand for articles, errors for failures and purchases for successes."""
    folder = run_folder(t.spark, "attempts")
    outcomes = t.given("events").where("event_type in ('error', 'purchase')").selectExpr(
        "user_id as article_id", "cast(ts as timestamp) as at", "event_id as seq", "event_type = 'purchase' as ok"
    )
    shape = T.StructType().add("article_id", "long").add("processing_state", "string").add("attempts", "long")
    states = KeyedTable(t.spark, f"{folder}/states", shape, "article_id", buckets=8)
    arrive(outcomes, F.unix_micros("at"), folder, lambda stream: steps.stream_attempts(stream, f"{folder}/checkpoint", states))
    return states.read(t.spark)


def query_recompare(t: Tables) -> DataFrame:
    folder = run_folder(t.spark, "recompare")
    articles = t.articles.select("article_id", "story_id", "outlet_id", "processing_state", "state_updated_at")
    shape = T.StructType().add("story_id", "long").add("n_articles", "long").add("n_outlets", "long").add("latest", "long")
    due = ResultTable(t.spark, f"{folder}/due", shape)
    comparisons = t.stored_comparisons.select("story_id", "generated_at")
    arrive(articles, F.col("article_id"), folder, lambda stream: steps.stream_recompare(stream, f"{folder}/checkpoint", due, comparisons))
    return due.read(t.spark).select("story_id").distinct()
