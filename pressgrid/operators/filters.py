"""Batch pickers, point lookups and request texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid import constants as C
from pressgrid.functions import text


def bounded(name: str, value: int, most: int) -> int:
    """A row limit that may decide about a broadcast, checked against its largest value."""
    if not 1 <= value <= most:
        raise ValueError(f"{name} lies in 1..{most}")
    return value


def eligible_batch(articles: DataFrame, state: str, limit: int = 100, outlet_id: int | None = None) -> DataFrame:
    """The next ``limit`` articles waiting in ``state``, lowest id first."""
    rows = articles.where(F.col("processing_state") == state)
    if outlet_id is not None:
        rows = rows.where(F.col("outlet_id") == outlet_id)
    return rows.orderBy("article_id").limit(limit)


def scoped_candidates(
    articles: DataFrame, outlets: DataFrame, limit: int, outlet_id: int | None = None, ids: DataFrame | None = None
) -> DataFrame:
    """Clustered articles of one outlet and/or an id list, with their outlet slug."""
    rows = articles.where("processing_state = 'clustered'").select("article_id", "outlet_id")
    if outlet_id is not None:
        rows = rows.where(F.col("outlet_id") == outlet_id)
    if ids is not None:
        rows = rows.join(ids, "article_id", "left_semi")
    return (
        rows.orderBy("article_id").limit(limit)
        .join(outlets.select("outlet_id", "slug"), "outlet_id")
        .select("article_id", F.col("slug").alias("outlet_slug"))
    )


def active_outlets(outlets: DataFrame, slugs: list[str] | None = None) -> DataFrame:
    """Active outlets, optionally of the chosen slugs, by name."""
    rows = outlets.where("active")
    if slugs is not None:
        rows = rows.where(F.col("slug").isin(slugs))
    return rows.orderBy("name")


def outlet_by_slug(outlets: DataFrame, slug: str) -> DataFrame:
    return outlets.where(F.col("slug") == slug)


ANALYSIS_FIELDS = ("framing_score", "framing_label", "framing_confidence", "headline_sentiment", "body_sentiment", "entities", "source_distribution", "analyzed_at")
ANALYSIS_LISTS = ("key_themes", "quoted_sources", "evidence_snippets")


def analysis_payload(analysis: DataFrame) -> DataFrame:
    """What a reader is given of each analysis; a missing list is an empty one."""
    lists = [F.coalesce(c, F.array().cast(analysis.schema[c].dataType)).alias(c) for c in ANALYSIS_LISTS]
    return analysis.select("article_id", *ANALYSIS_FIELDS, *lists)


def article_detail(articles: DataFrame, outlets: DataFrame, analysis: DataFrame, article_id: int | None = None) -> DataFrame:
    """Article with outlet and its whole analysis (all null without one).

    The body itself is not returned, only whether it exists.  With ``article_id`` both tables are cut before the join.
    """
    if article_id is not None:
        articles, analysis = (rows.where(F.col("article_id") == article_id) for rows in (articles, analysis))
    return (
        articles.select(
            "article_id", "outlet_id", "story_id", "url", "headline", "author", "published_at", "image_url", "processing_state",
            F.coalesce(F.length("full_text") > 0, F.lit(False)).alias("full_text_available"),
        )
        .join(outlets.select("outlet_id", "slug", "name"), "outlet_id")
        .join(analysis_payload(analysis), "article_id", "left")
    )


def embed_text_of(headline: Column, body: Column, body_chars: int | None = None) -> Column:
    """Headline, blank line, body (its first ``body_chars`` characters if given), trimmed."""
    body = F.coalesce(body, F.lit(""))
    return text.strip(F.concat(headline, F.lit("\n\n"), body if body_chars is None else F.substring(body, 1, body_chars)))


def embed_text(articles: DataFrame, body_chars: int = C.EMBED_BODY_CHARS) -> DataFrame:
    """Text for an encoder that reads only the first ``body_chars`` characters of a body."""
    return articles.select("article_id", embed_text_of(F.col("headline"), F.col("full_text"), body_chars).alias("embed_text"))


def enrich_requests(articles: DataFrame, outlets: DataFrame, template: str, body_chars: int = C.PROMPT_BODY_CHARS) -> DataFrame:
    """Request text per article with the first ``body_chars`` characters of the body.

    The body goes in last, so marks inside it stay as they are.
    """
    blank = F.lit("")
    filled = F.replace(F.lit(template), F.lit("{outlet_slug}"), F.coalesce("slug", blank))
    filled = F.replace(filled, F.lit("{headline}"), F.coalesce("headline", blank))
    body = F.substring(F.coalesce("full_text", blank), 1, body_chars)
    return (
        articles.select("article_id", "outlet_id", "headline", "full_text")
        .join(outlets.select("outlet_id", "slug"), "outlet_id")
        .select("article_id", F.replace(filled, F.lit("{body}"), body).alias("request"))
    )


def compare_requests(context: DataFrame, stories: DataFrame, themes: DataFrame) -> DataFrame:
    """Header line of each story's comparison request: title and number of distinct themes.

    The article records follow as the rows of the story context, in id order.
    """
    n_themes = themes.groupBy("story_id").agg(F.count(F.lit(1)).alias("theme_count"))
    n_articles = context.groupBy("story_id").agg(F.count(F.lit(1)).alias("record_count"))
    return n_articles.join(n_themes, "story_id", "left").join(stories.select("story_id", "title"), "story_id")
