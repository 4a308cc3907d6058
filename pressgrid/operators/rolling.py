"""Stored outlet statistics over a moving window of days.

Each day keeps one partial per outlet and per outlet and theme: counts and sums of whole hundredths, so partials merge
and can be taken back exactly, in any order.  A window is the sum of its days' partials, or the window before it plus
the days that come in minus the days that go; articles are read only when their day is refreshed.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrid.session import folder_done
from pressgrid.sources.sinks import drop_partitions, overwrite_partitions

NUMBERS = ("n", "framing_sum", "framing_n", "body_sum", "body_n")
SCHEMA = "outlet_id long, theme string, " + ", ".join(f"{c} long" for c in NUMBERS) + ", day date"


def daily_partials(articles: DataFrame, analysis: DataFrame) -> DataFrame:
    """day, outlet_id, theme, the numbers: one pass over the analysed articles, summed before the shuffle.

    The row with a null theme counts the outlet's articles and holds their scores.  Articles without a date have no day
    and so no partial.
    """
    dated = articles.where("published_at is not null").select("article_id", "outlet_id", F.to_date("published_at").alias("day"))
    no_theme = F.lit(None).cast("string")
    themes = F.filter(F.coalesce("key_themes", F.array().cast("array<string>")), lambda t: t.isNotNull())
    rows = (
        analysis.select("article_id", "framing_score", "body_sentiment", "key_themes")
        .join(dated, "article_id")
        .select("day", "outlet_id", "framing_score", "body_sentiment", F.explode(F.concat(F.array(no_theme), themes)).alias("theme"))
    )

    def scored(name: str) -> Column:
        return F.when(F.col("theme").isNull(), (F.col(name) * 100).cast("long"))

    zero = F.lit(0).cast("long")
    return rows.groupBy("day", "outlet_id", "theme").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(scored("framing_score")), zero).alias("framing_sum"),
        F.count(scored("framing_score")).alias("framing_n"),
        F.coalesce(F.sum(scored("body_sentiment")), zero).alias("body_sum"),
        F.count(scored("body_sentiment")).alias("body_n"),
    )


def merged(partials: DataFrame) -> DataFrame:
    """Sum partials of any days into one row per outlet and theme; what was taken back wholly goes."""
    return partials.groupBy("outlet_id", "theme").agg(*(F.sum(c).alias(c) for c in NUMBERS)).where("n <> 0")


class DailyOutletStats:
    """Partials stored by day under ``path``, a folder all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        if not folder_done(spark, path):
            overwrite_partitions(spark.createDataFrame([], SCHEMA), path, "day")

    def refresh(self, articles: DataFrame, analysis: DataFrame, first: date | None = None, days: int = 1) -> None:
        """Replace the partials of ``days`` days from ``first`` on (of every day with articles if not given).

        Days outside stay; a repeated refresh changes nothing.  Days left without analysed articles lose their partials.
        A window that holds a refreshed day has to be taken with ``window`` again, not moved.
        """
        if first is not None:
            last = first + timedelta(days=days)
            articles = articles.where((F.col("published_at") >= F.lit(first).cast("timestamp")) & (F.col("published_at") < F.lit(last).cast("timestamp")))
            drop_partitions(self.spark, self.path, "day", [str(first + timedelta(days=k)) for k in range(days)])
        overwrite_partitions(daily_partials(articles, analysis), self.path, "day")

    def _between(self, first: date, end: date) -> DataFrame:
        rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        return rows.where((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(end))).drop("day")

    def window(self, end: date, days: int = 30) -> DataFrame:
        """Sums of the ``days`` days before ``end``; other days are not read."""
        return merged(self._between(end - timedelta(days=days), end))

    def moved(self, window: DataFrame, old_end: date, end: date, days: int = 30) -> DataFrame:
        """The window that ended before ``old_end``, moved on to ``end``: reads only the days that come in or go."""
        if end < old_end:
            raise ValueError("a window moves forward only")
        old_first, first = old_end - timedelta(days=days), end - timedelta(days=days)
        gone = self._between(old_first, min(first, old_end)).select("outlet_id", "theme", *((-F.col(c)).alias(c) for c in NUMBERS))
        return merged(window.unionByName(self._between(max(old_end, first), end)).unionByName(gone))


def window_stats(window: DataFrame) -> DataFrame:
    """Per outlet: analysed articles, averages rounded to 2 places, and its themes as rows (one null theme if none)."""

    def mean(name: str) -> Column:
        hundreds = F.when(F.col(f"{name}_n") > 0, F.col(f"{name}_n") * 100).cast("decimal(20,0)")
        return F.round(F.col(f"{name}_sum").cast("decimal(28,10)") / hundreds, 2).cast("double")

    averages = window.where("theme is null").select(
        "outlet_id", F.col("n").alias("article_count"), mean("framing").alias("avg_framing"), mean("body").alias("avg_sentiment")
    )
    themes = window.where("theme is not null").select("outlet_id", "theme", F.col("n").alias("theme_count"))
    return averages.join(themes, "outlet_id", "left")
