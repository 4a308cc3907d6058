"""Overview counts, daily trends and per-outlet statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid import constants as C
from pressgrid.functions import labels, numbers


def since(as_of: Column, days: int = 0, hours: int = 0) -> Column:
    """The instant ``days`` and ``hours`` before ``as_of``."""
    return as_of - F.make_dt_interval(F.lit(days), F.lit(hours))


def overview_counts(articles: DataFrame, stories: DataFrame, outlets: DataFrame, as_of: Column) -> DataFrame:
    """One row: totals, active outlets, and the last 24 hours (boundary included)."""
    day_ago = since(as_of, hours=24)
    story_counts = stories.agg(
        F.count(F.lit(1)).alias("story_count"),
        F.count_if(F.col("last_seen_at") >= day_ago).alias("stories_last_24h"),
    )
    active = outlets.where("active").agg(F.count(F.lit(1)).alias("n"))
    return articles.agg(
        F.count(F.lit(1)).alias("article_count"),
        F.count_if(F.col("published_at") >= day_ago).alias("articles_last_24h"),
    ).select(
        "article_count",
        story_counts.select("story_count").scalar().alias("story_count"),
        active.scalar().alias("active_outlet_count"),
        "articles_last_24h",
        story_counts.select("stories_last_24h").scalar().alias("stories_last_24h"),
    )


def articles_by_state(articles: DataFrame) -> DataFrame:
    return articles.groupBy("processing_state").agg(F.count(F.lit(1)).alias("n"))


def framing_distribution_all(analysis: DataFrame) -> DataFrame:
    """Count per label; unlabelled analyses are left out."""
    return (
        analysis.where("framing_label is not null")
        .groupBy(F.col("framing_label").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def latest_ingestion_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(1)


def analysed_pct(articles: DataFrame) -> DataFrame:
    """Share of analysed articles in whole per cent, halves up; 0 when empty."""
    done = F.count_if(F.col("processing_state").isin("complete", "analyzed"))
    total = F.count(F.lit(1))
    return articles.agg(done.alias("analysed"), total.alias("total")).select(
        "analysed",
        "total",
        F.when(F.col("total") == 0, F.lit(0).cast("long"))
        .otherwise(numbers.half_up_int(F.try_divide("analysed", "total") * 100))
        .alias("pct"),
    )


def _per_day(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    if not 1 <= days <= 90:
        raise ValueError("days must lie in 1..90")
    return (
        df.where(F.col(ts) >= since(as_of, days=days))
        .groupBy(F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def articles_per_day(articles: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """UTC daily counts over the last ``days`` days, no gap filling, by date."""
    return _per_day(articles, "published_at", as_of, days).orderBy("date")


def stories_per_day(stories: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return _per_day(stories, "last_seen_at", as_of, days).orderBy("date")


def framing_distribution_window(
    articles: DataFrame, analysis: DataFrame, as_of: Column, days: int = 7
) -> DataFrame:
    """Label counts of articles published in the window; null counts as 'unlabeled'."""
    recent = articles.where(F.col("published_at") >= since(as_of, days=days)).select("article_id")
    return (
        analysis.select("article_id", "framing_label")
        .join(recent, "article_id")
        .groupBy(F.coalesce("framing_label", F.lit("unlabeled")).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def trend_series(articles: DataFrame, stories: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Both daily series side by side, missing days of either as 0."""
    a = _per_day(articles, "published_at", as_of, days).withColumnRenamed("n", "articles")
    s = _per_day(stories, "last_seen_at", as_of, days).withColumnRenamed("n", "stories")
    zero = F.lit(0).cast("long")
    return (
        a.join(s, "date", "full")
        .select("date", F.coalesce("articles", zero).alias("articles"), F.coalesce("stories", zero).alias("stories"))
        .orderBy("date")
    )


def trend_totals(series: DataFrame) -> DataFrame:
    return series.agg(F.sum("articles").alias("articles"), F.sum("stories").alias("stories"))


def framing_partition(distribution: DataFrame) -> DataFrame:
    """Fold (label, n) into the display labels.

    The three primary labels always appear with their share of the primary
    total; the others only when counted, without a share.
    """
    folded = F.when(F.col("label").isin(*C.DISPLAY_LABELS), F.col("label")).otherwise("unlabeled")
    sums = [
        F.coalesce(F.sum(F.when(folded == label, F.col("n"))), F.lit(0).cast("long")).alias(label)
        for label in C.DISPLAY_LABELS
    ]
    primary = C.DISPLAY_LABELS[:3]
    total = sum((F.col(x) for x in primary[1:]), F.col(primary[0]))
    rows = [
        F.struct(
            F.lit(i + 1).cast("long").alias("position"),
            F.lit(label).alias("label"),
            F.lit(label in primary).alias("is_primary"),
            F.col(label).alias("n"),
            (
                F.when(total > 0, F.try_divide(F.col(label), total)).otherwise(F.lit(0.0))
                if label in primary
                else F.lit(None).cast("double")
            ).alias("share"),
        )
        for i, label in enumerate(C.DISPLAY_LABELS)
    ]
    return (
        distribution.agg(*sums)
        .select(F.inline(F.array(*rows)))
        .where("is_primary or n > 0")
    )


def _analysed_since(articles: DataFrame, analysis: DataFrame, as_of: Column, days: int, *columns: str) -> DataFrame:
    recent = articles.where(F.col("published_at") >= since(as_of, days=days)).select("article_id", "outlet_id")
    return analysis.select("article_id", *columns).join(recent, "article_id")


def outlet_theme_counts(articles: DataFrame, analysis: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(outlet, theme) counts over the analysed articles of the window."""
    return (
        _analysed_since(articles, analysis, as_of, days, "key_themes")
        .select("outlet_id", F.explode("key_themes").alias("theme"))
        .where("theme is not null")
        .groupBy("outlet_id", "theme")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def outlet_averages(articles: DataFrame, analysis: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    return (
        _analysed_since(articles, analysis, as_of, days, "framing_score", "body_sentiment")
        .groupBy("outlet_id")
        .agg(
            F.count(F.lit(1)).alias("article_count"),
            numbers.mean_2dp(F.col("framing_score")).alias("avg_framing"),
            numbers.mean_2dp(F.col("body_sentiment")).alias("avg_sentiment"),
        )
    )


def outlet_30d_stats(articles: DataFrame, analysis: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Per outlet: analysed articles, rounded averages, and its themes as rows.

    An outlet without themes keeps one row with a null theme.  Themes stay rows,
    so an outlet with very many distinct themes never builds one wide value.
    """
    averages = outlet_averages(articles, analysis, as_of, days)
    themes = outlet_theme_counts(articles, analysis, as_of, days)
    return averages.join(
        themes.select("outlet_id", "theme", F.col("n").alias("theme_count")), "outlet_id", "left"
    )


def outlet_stats(outlets: DataFrame, averages: DataFrame) -> DataFrame:
    """Every outlet with its window averages; 0 and nulls when it has none."""
    return outlets.select("outlet_id", "slug", "name").join(averages, "outlet_id", "left").select(
        "outlet_id",
        "slug",
        "name",
        F.coalesce("article_count", F.lit(0).cast("long")).alias("article_count"),
        "avg_framing",
        "avg_sentiment",
    )


def outlet_directory(outlets: DataFrame, ratings: DataFrame) -> DataFrame:
    """Outlets with their external rating label and category, by name."""
    rated = ratings.where(F.col("source") == C.BIAS_SOURCE_PRIORITY[0]).select(
        "outlet_id",
        "original_label",
        labels.bias_category(F.col("source"), F.col("original_label")).alias("category"),
        "rating_url",
    )
    return (
        outlets.select("outlet_id", "slug", "name", "website", "active")
        .join(rated, "outlet_id", "left")
        .orderBy("name")
    )
