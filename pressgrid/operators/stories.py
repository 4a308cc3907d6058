"""Per-story rules: sentiment, ratings, images, framing, themes, sources, entities.

All operators work for every story in one job.  They aggregate by story first
(partial aggregation shrinks a hot story before the shuffle) and join the
one-row-per-story results afterwards.  Results whose size grows with a story
(articles, themes, quotes) stay rows and are never gathered into one value;
only the distinct outlets of a story are, after removing duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressgrid import constants as C
from pressgrid.functions import labels, numbers, text
from pressgrid.operators.dashboards import since
from pressgrid.operators.filters import analysis_payload, bounded

MAX_IMAGES = 3


# --- listings ---------------------------------------------------------------

def fresh_stories(stories: DataFrame, as_of: Column, hours: int = C.HOME_FRESH_HOURS) -> DataFrame:
    """Stories last seen within ``hours`` (boundary included)."""
    return stories.where(F.col("last_seen_at") >= since(as_of, hours=max(1, hours)))


def story_outlets(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Per story: sorted distinct outlet slugs and their number."""
    pairs = articles.where("story_id is not null").select("story_id", "outlet_id").distinct()
    return (
        pairs.join(outlets.select("outlet_id", "slug"), "outlet_id")
        .groupBy("story_id")
        .agg(
            F.array_sort(F.collect_set("slug")).alias("outlet_slugs"),
            F.count(F.lit(1)).alias("outlet_count"),
        )
    )


def image_cap(article_count: Column) -> Column:
    return (
        F.when(article_count < 2, 0).when(article_count <= 6, 1).when(article_count <= 10, 2).otherwise(MAX_IMAGES)
    )


def story_images(articles: DataFrame, outlets: DataFrame, stories: DataFrame) -> DataFrame:
    """Images of each story in order: outlets take turns, newest image first, no URL twice.

    Every turn that is not the last adds an image and at most three are shown,
    so three images per outlet are enough; that limit is pushed below the
    shuffle, which also keeps a hot outlet small.  A turn without any new URL
    ends the selection.
    """
    per_outlet = W.partitionBy("story_id", "outlet_id")
    turns = (
        articles.where(F.col("story_id").isNotNull() & text.blank_to_null(F.col("image_url")).isNotNull())
        .select("story_id", "outlet_id", "article_id", "image_url", "published_at")
        .withColumn("turn", F.row_number().over(per_outlet.orderBy(F.desc("published_at"), "article_id")))
        .where(F.col("turn") <= MAX_IMAGES)
        .withColumn("newest", F.max("published_at").over(per_outlet))
        .join(outlets.select("outlet_id", "slug", "name"), "outlet_id")
    )
    place = F.struct("turn", (-F.unix_micros("newest")).alias("age"), "slug", "article_id", "name")
    firsts = turns.groupBy("story_id", F.col("image_url").alias("url")).agg(F.min(place).alias("place"))
    per_story = W.partitionBy("story_id")
    turn = F.col("place.turn")
    live = (
        firsts.withColumn("has_2", F.max(turn == 2).over(per_story))
        .withColumn("has_3", F.max(turn == 3).over(per_story))
        .where((turn == 1) | ((turn == 2) & F.col("has_2")) | ((turn == 3) & F.col("has_2") & F.col("has_3")))
        .withColumn("rank_no", F.row_number().over(per_story.orderBy("place")))
        .where(F.col("rank_no") <= MAX_IMAGES)
    )
    return (
        live.join(stories.select("story_id", "article_count"), "story_id")
        .where(F.col("rank_no") <= image_cap(F.col("article_count")))
        .select("story_id", "rank_no", F.col("place.article_id").alias("article_id"),
                F.col("place.slug").alias("slug"), F.col("place.name").alias("name"), "url")
    )


def hydrate(page: DataFrame, articles: DataFrame, outlets: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Add outlet slugs, framing spread and hero image to a bounded page of stories."""
    ids = F.broadcast(page.select("story_id"))  # at most one page of rows
    covering = articles.join(ids, "story_id", "left_semi")
    hero = story_images(covering, outlets, page).where("rank_no = 1").select(
        "story_id", F.col("url").alias("hero_image_url")
    )
    return (
        page.join(story_outlets(covering, outlets), "story_id", "left")
        .join(comparisons.select("story_id", F.col("framing_spread").cast("double").alias("framing_spread")), "story_id", "left")
        .join(hero, "story_id", "left")
    )


def stories_page(
    stories: DataFrame, articles: DataFrame, outlets: DataFrame, comparisons: DataFrame,
    as_of: Column, page: int = 1, limit: int = 20, fresh: bool = False,
) -> DataFrame:
    """One page of stories, latest first, with totals; the limit comes before the joins."""
    if page < 1 or not 1 <= limit <= 100:
        raise ValueError("page starts at 1 and limit lies in 1..100")
    pool = fresh_stories(stories, as_of) if fresh else stories
    offset = (page - 1) * limit
    rows = pool.orderBy(F.desc("last_seen_at"), F.desc("story_id")).offset(offset).limit(limit)
    total = pool.agg(F.count(F.lit(1))).scalar()
    return (
        hydrate(rows, articles, outlets, comparisons)
        .select(
            "story_id", "title", "topic", "first_seen_at", "last_seen_at", "article_count",
            "outlet_slugs", "framing_spread", "hero_image_url",
            total.alias("total"),
        )
        .withColumn("has_more", F.lit(offset + limit) < F.col("total"))
    )


def home_sections(stories: DataFrame, articles: DataFrame, outlets: DataFrame, as_of: Column) -> DataFrame:
    """Hot now, just updated and discover: disjoint picks from the 40 latest fresh stories."""
    pool = (
        fresh_stories(stories, as_of)
        .orderBy(F.desc("last_seen_at"), F.desc("story_id"))
        .limit(C.HOME_POOL)
        .select("story_id", "article_count", "last_seen_at")
    )
    covering = articles.join(F.broadcast(pool.select("story_id")), "story_id", "left_semi")
    counts = (
        covering.select("story_id", "outlet_id").distinct().groupBy("story_id").agg(F.count(F.lit(1)).alias("outlet_count"))
    )
    recency = [F.desc("last_seen_at"), F.desc("story_id")]
    coverage = [F.desc("outlet_count"), F.desc("article_count"), *recency]
    one_page = W.partitionBy(F.lit(0))  # at most 40 rows
    rows = pool.join(counts, "story_id", "left").withColumn("outlet_count", F.coalesce("outlet_count", F.lit(0)))
    rows = rows.withColumn("hot", F.row_number().over(one_page.orderBy(*coverage)))
    taken = F.col("hot") <= C.HOT_NOW
    rows = rows.withColumn("late", F.row_number().over(W.partitionBy(taken).orderBy(*recency)))
    updated = ~taken & (F.col("late") <= C.JUST_UPDATED)
    rest = ~taken & ~updated
    rows = rows.withColumn("wide", F.row_number().over(W.partitionBy(rest).orderBy(*coverage)))
    section = (
        F.when(taken, "hot_now").when(updated, "just_updated").when(rest & (F.col("wide") <= C.DISCOVER), "discover")
    )
    position = F.when(taken, F.col("hot")).when(updated, F.col("late")).otherwise(F.col("wide"))
    return rows.select(section.alias("section"), position.alias("position"), "story_id", "outlet_count",
                       "article_count", "last_seen_at").where("section is not null")


def story_detail(
    stories: DataFrame, articles: DataFrame, outlets: DataFrame, analysis: DataFrame, comparisons: DataFrame, story_id: int | None = None
) -> DataFrame:
    """Story, article, outlet, whole analysis and comparison side by side, one row per article.

    Article order inside a story is (published_at, article_id).  What belongs to the story as a whole is in
    ``story_header``; articles stay rows, since a story may hold any number of them.
    """
    if story_id is not None:
        stories, articles, comparisons = (rows.where(F.col("story_id") == story_id) for rows in (stories, articles, comparisons))
    rows = (
        articles.where("story_id is not null")
        .select("story_id", "article_id", "outlet_id", "headline", "url", "author", "published_at", "image_url",
                "processing_state")
        .join(outlets.select("outlet_id", "slug", "name"), "outlet_id")
        .join(analysis_payload(analysis), "article_id", "left")
    )
    heads = stories.select("story_id", "title", "topic", "last_seen_at", "article_count").join(
        comparisons.select("story_id", "differences", "framing_spread"), "story_id", "left"
    )
    return rows.join(heads, ["story_id"], "inner")


def story_header(
    stories: DataFrame, articles: DataFrame, outlets: DataFrame, comparisons: DataFrame, ratings: DataFrame,
    story_id: int | None = None, priority: tuple[str, ...] = C.BIAS_SOURCE_PRIORITY,
) -> DataFrame:
    """One row per story with all that its page shows beside the articles.

    Comparison (null without one), outlets, images in order, rated coverage and the ratings behind it.  The lists hold
    at most three images and one entry per outlet.
    """
    if story_id is not None:
        stories, articles, comparisons = (rows.where(F.col("story_id") == story_id) for rows in (stories, articles, comparisons))
    images = story_images(articles, outlets, stories).groupBy("story_id").agg(
        F.array_sort(F.collect_list(F.struct("rank_no", "article_id", "slug", "name", "url"))).alias("story_images")
    )
    source = F.struct("category_order", F.lower("name").alias("by_name"), "outlet_id", "slug", "name", "original_label",
                      "category", "source", "rating_url", "rated_at")
    sources = bias_sources(articles, outlets, ratings, priority).groupBy("story_id").agg(
        F.array_sort(F.collect_list(source)).alias("bias_sources")
    )
    compared = comparisons.select("story_id", "differences", "framing_spread", "coverage_matrix", "not_present_here", "generated_at")
    wide = (
        stories.select("story_id", "title", "topic", "first_seen_at", "last_seen_at", "article_count", "summary")
        .join(story_outlets(articles, outlets), "story_id", "left")
        .join(compared, "story_id", "left")
        .join(images, "story_id", "left")
        .join(bias_distribution(articles, outlets, ratings, priority), "story_id", "left")
        .join(sources, "story_id", "left")
    )
    for name, frame in (("story_images", images), ("bias_sources", sources)):
        wide = wide.withColumn(name, F.coalesce(name, F.array().cast(frame.schema[name].dataType)))
    return wide.withColumn("hero_image_url", F.get("story_images", F.lit(0))["url"])


# --- positive stories ---------------------------------------------------------

def story_sentiment_agg(
    stories: DataFrame, articles: DataFrame, analysis: DataFrame, as_of: Column, days: int = C.POSITIVE_WINDOW_DAYS
) -> DataFrame:
    """Sentiment summary of each fresh story over its articles with a body sentiment."""
    scored = analysis.where("body_sentiment is not null").select("article_id", "body_sentiment")
    per_story = (
        articles.where("story_id is not null")
        .select("article_id", "story_id", "outlet_id")
        .join(scored, "article_id")
        .groupBy("story_id")
        .agg(
            F.count_distinct("outlet_id").alias("distinct_outlets"),
            F.count(F.lit(1)).alias("analyzed_articles"),
            F.count_if(F.col("body_sentiment") >= C.POSITIVE_ARTICLE).alias("positive_articles"),
            numbers.mean(F.col("body_sentiment")).alias("mean_body_sentiment"),
        )
    )
    fresh = stories.where(F.col("last_seen_at") >= since(as_of, days=days)).select("story_id", "last_seen_at")
    return fresh.join(per_story, "story_id")


def positive_story_reasons(aggregates: DataFrame, as_of: Column, days: int = C.POSITIVE_WINDOW_DAYS) -> DataFrame:
    """First rule a story fails, or null when it qualifies."""
    mean = F.col("mean_body_sentiment")
    share = F.try_divide("positive_articles", "analyzed_articles")
    reason = (
        F.when(F.col("last_seen_at") < since(as_of, days=days), "stale")
        .when(F.col("distinct_outlets") < C.POSITIVE_MIN_OUTLETS, "too_few_outlets")
        .when((F.col("analyzed_articles") < C.POSITIVE_MIN_ANALYZED) | mean.isNull(), "too_few_analyzed")
        .when(mean < C.POSITIVE_MEAN, "mean_too_low")
        .when(F.coalesce(share, F.lit(0.0)) < C.POSITIVE_FRACTION, "consensus_too_low")
    )
    return aggregates.withColumn("reason", reason)


def positive_stories(
    stories: DataFrame, articles: DataFrame, outlets: DataFrame, analysis: DataFrame, comparisons: DataFrame,
    as_of: Column, limit: int = C.POSITIVE_LIMIT,
) -> DataFrame:
    """The most positive qualifying stories, listed like a stories page; ``limit`` lies in 1..40."""
    bounded("limit", limit, 40)
    judged = positive_story_reasons(story_sentiment_agg(stories, articles, analysis, as_of), as_of)
    top = (
        judged.where("reason is null")
        .orderBy(F.desc("mean_body_sentiment"), F.desc("distinct_outlets"), F.desc("last_seen_at"), F.desc("story_id"))
        .limit(limit)
        .drop("last_seen_at", "reason")
    )
    page = stories.join(F.broadcast(top), "story_id")
    return hydrate(page, articles, outlets, comparisons)


# --- publication ratings ---------------------------------------------------------

def chosen_ratings(ratings: DataFrame, priority: tuple[str, ...] = C.BIAS_SOURCE_PRIORITY) -> DataFrame:
    """One rating per outlet by source priority, with the category read anew from its label."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("source"))
    stored = F.when(F.col("normalized_category").isin(*C.BIAS_CATEGORIES), F.col("normalized_category"))
    best = ratings.where(F.col("source").isin(*priority)).groupBy("outlet_id").agg(
        F.min_by(F.struct("source", "original_label", "normalized_category", "rating_url", "rated_at"), order).alias("r")
    )
    return best.select("outlet_id", "r.*").select(
        "outlet_id",
        "source",
        "original_label",
        "rating_url",
        "rated_at",
        F.coalesce(labels.bias_category(F.col("source"), F.col("original_label")), stored).alias("category"),
    ).where("category is not null")


def _rated_coverage(articles: DataFrame, outlets: DataFrame, ratings: DataFrame, priority) -> DataFrame:
    covering = articles.where("story_id is not null").select("story_id", "outlet_id").distinct()
    rated_outlets = outlets.select("outlet_id", "slug", "name").join(
        chosen_ratings(ratings, priority), "outlet_id", "left"
    )
    return covering.join(rated_outlets, "outlet_id")


def bias_distribution(
    articles: DataFrame, outlets: DataFrame, ratings: DataFrame, priority: tuple[str, ...] = C.BIAS_SOURCE_PRIORITY
) -> DataFrame:
    """Per story: rated and unrated outlets, category counts and percentages when eligible."""
    counts = (
        _rated_coverage(articles, outlets, ratings, priority)
        .groupBy("story_id")
        .agg(
            F.count(F.lit(1)).alias("total_outlet_count"),
            F.count("category").alias("rated"),
            *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in C.BIAS_CATEGORIES],
            F.array_sort(F.collect_set("slug")).alias("all_slugs"),
            F.array_sort(F.collect_set(F.when(F.col("category").isNull(), F.col("slug")))).alias("open_slugs"),
        )
    )
    few = F.col("total_outlet_count") < C.BIAS_MIN_OUTLETS
    eligible = ~few & (F.col("rated") >= C.BIAS_MIN_RATED)
    rated = F.when(few, F.lit(0).cast("long")).otherwise(F.col("rated"))
    return counts.select(
        "story_id",
        eligible.alias("eligible"),
        F.when(few, "too_few_outlets").when(~eligible, "too_few_rated_outlets").alias("reason"),
        "total_outlet_count",
        rated.alias("rated_outlet_count"),
        (F.col("total_outlet_count") - rated).alias("unrated_outlet_count"),
        F.when(few, F.col("all_slugs")).otherwise(F.col("open_slugs")).alias("unrated_slugs"),
        *[F.when(eligible, F.col(f"n_{c}")).otherwise(F.lit(0).cast("long")).alias(f"{c}_count") for c in C.BIAS_CATEGORIES],
        *[
            F.when(eligible, F.bround(F.try_divide(F.col(f"n_{c}"), F.col("rated")) * 100.0, 2))
            .otherwise(F.lit(0.0))
            .alias(f"{c}_pct")
            for c in C.BIAS_CATEGORIES
        ],
    )


def bias_sources(
    articles: DataFrame, outlets: DataFrame, ratings: DataFrame, priority: tuple[str, ...] = C.BIAS_SOURCE_PRIORITY
) -> DataFrame:
    """The rating rows behind each eligible distribution; order (category_order, lower(name))."""
    coverage = _rated_coverage(articles, outlets, ratings, priority)
    eligible = bias_distribution(articles, outlets, ratings, priority).where("eligible").select("story_id")
    rank = F.array_position(F.array(*[F.lit(c) for c in C.BIAS_CATEGORIES]), F.col("category"))
    return (
        coverage.where("category is not null")
        .join(eligible, "story_id", "left_semi")
        .select("story_id", rank.alias("category_order"), "outlet_id", "slug", "name", "original_label", "category",
                "source", "rating_url", "rated_at")
    )


# --- framing ---------------------------------------------------------------------

def _story_analysis(articles: DataFrame, outlets: DataFrame | None, analysis: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    rows = articles.where("story_id is not null").select("story_id", "article_id", "outlet_id").join(
        analysis.select("article_id", *columns), "article_id", how
    )
    if outlets is not None:
        rows = rows.join(outlets.select("outlet_id", "slug", "name"), "outlet_id")
    return rows


def framing_by_outlet(articles: DataFrame, outlets: DataFrame, analysis: DataFrame) -> DataFrame:
    """Per (story, outlet): article and scored counts, means and bucket; scored outlets first."""
    grouped = (
        _story_analysis(articles, None, analysis, "framing_score", "framing_confidence", how="left")
        .groupBy("story_id", "outlet_id")
        .agg(
            F.count(F.lit(1)).alias("article_count"),
            F.count("framing_score").alias("scored_count"),
            F.try_divide(F.sum("framing_score").cast("double"), F.count("framing_score")).alias("mean_score"),
            F.try_divide(F.sum("framing_confidence").cast("double"), F.count("framing_confidence")).alias("mean_confidence"),
        )
    )
    return grouped.join(outlets.select("outlet_id", "slug", "name"), "outlet_id").select(
        "story_id", "slug", "name", "article_count", "scored_count", "mean_score", "mean_confidence",
        labels.framing_bucket(F.col("mean_score")).alias("bucket"),
        F.col("mean_score").isNull().alias("sorts_last"),
    )


def framing_spread(articles: DataFrame, analysis: DataFrame) -> DataFrame:
    """Population deviation of the framing scores of analysed articles: clamped, 2 places, 0 below two scores."""
    ready = articles.where(F.col("processing_state").isin("analyzed", "complete"))
    grouped = (
        _story_analysis(ready, None, analysis, "framing_score")
        .groupBy("story_id")
        .agg(F.count("framing_score").alias("n"), numbers.stddev_pop_exact(F.col("framing_score")).alias("sd"))
    )
    spread = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.bround(numbers.clamp(F.col("sd"), 0.0, 2.0), 2))
    return grouped.select("story_id", F.col("n").alias("scored"), spread.alias("framing_spread"))


def framing_spread_nullable(articles: DataFrame, analysis: DataFrame) -> DataFrame:
    """The same deviation over all scored articles, unrounded, null below two scores."""
    return (
        _story_analysis(articles, None, analysis, "framing_score")
        .groupBy("story_id")
        .agg(F.count("framing_score").alias("scored"), numbers.stddev_pop_exact(F.col("framing_score")).alias("sd"))
        .select("story_id", "scored", F.when(F.col("scored") >= 2, F.col("sd")).alias("spread"))
    )


# --- themes and comparison documents ------------------------------------------------

def theme_union(articles: DataFrame, analysis: DataFrame) -> DataFrame:
    """Distinct trimmed themes per story; first-seen order is (first_article, first_pos)."""
    ready = articles.where(F.col("processing_state").isin("analyzed", "complete"))
    return (
        _story_analysis(ready, None, analysis, "key_themes")
        .select("story_id", "article_id", F.posexplode("key_themes").alias("pos", "raw"))
        .select("story_id", "article_id", "pos", text.blank_to_null(F.col("raw")).alias("theme"))
        .where("theme is not null")
        .groupBy("story_id", "theme")
        .agg(F.min(F.struct("article_id", "pos")).alias("first"))
        .select("story_id", "theme", F.col("first.article_id").alias("first_article"), F.col("first.pos").alias("first_pos"))
    )


def _kind(value: Column) -> Column:
    """JSON type of a variant: OBJECT, ARRAY, STRING, VOID or a scalar type."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def _inner_list(value: Column, keys: tuple[str, ...]) -> Column:
    """The first list found under one of the wrapper keys of a JSON object."""
    found = [F.try_variant_get(value, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*[F.when(_kind(f) == "ARRAY", f) for f in found])


def _json_cells(comparisons: DataFrame, column: str) -> DataFrame:
    parsed = F.try_variant_get(F.try_parse_json(F.col(column)), "$", "map<string,variant>")
    # Outer, so that no size test makes Spark parse each document twice.
    cells = comparisons.select("story_id", F.explode_outer(parsed).alias("key", "cell")).where("key is not null")
    return cells.withColumn("slug", text.strip(F.col("key")))


def _outlet_names(cells: DataFrame, articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Display name of a cell's outlet: that of an outlet covering the story, else made from the key."""
    known = (
        articles.where("story_id is not null").select("story_id", "outlet_id").distinct()
        .join(outlets.select("outlet_id", "slug", "name"), "outlet_id")
        .select("story_id", "slug", "name")
    )
    return cells.join(known, ["story_id", "slug"], "left").withColumn(
        "name", F.coalesce("name", text.title_from_key(F.col("slug")))
    )


def _weight(value: Column) -> Column:
    kind = _kind(value)
    as_text = text.strip(F.try_variant_get(value, "$", "string"))
    number = F.when(
        kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL"), F.try_variant_get(value, "$", "double")
    ).when(kind == "STRING", F.when(as_text == "", F.lit(0.0)).otherwise(as_text.try_cast("double")))
    finite = ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(finite, numbers.clamp(number, 0.0, 1.0))


def outlet_emphasis(comparisons: DataFrame, articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """(story, outlet, theme, weight) from the coverage matrix, in display order.

    A cell may be a weight map, a list of names, a list under a wrapper key, or
    one name.  ``theme_no`` orders the themes of an outlet, ``theme_count`` (more
    first) and ``name`` order the outlets.  An outlet with no theme keeps one
    row with a null theme.
    """
    cells = _outlet_names(_json_cells(comparisons, "coverage_matrix"), articles, outlets)
    cell = F.col("cell")
    kind = _kind(cell)
    listed = F.coalesce(F.when(kind == "ARRAY", cell), F.when(kind == "OBJECT", _inner_list(cell, ("themes", "items", "points", "highlights"))))
    no_weight = F.lit(None).cast("double")

    def named(label: Column, position: Column, weight: Column) -> Column:
        return F.struct(
            (-F.coalesce(weight, F.lit(0.0))).alias("order"), position.cast("int").alias("pos"),
            text.strip(label).alias("label"), weight.alias("weight"),
        )

    from_list = F.transform(
        F.filter(F.try_variant_get(listed, "$", "array<variant>"), lambda v: _kind(v) == "STRING"),
        lambda v, i: named(F.try_variant_get(v, "$", "string"), i, no_weight),
    )
    from_map = F.transform(
        F.map_entries(F.try_variant_get(cell, "$", "map<string,variant>")),
        lambda e, i: named(e["key"], F.lit(0), _weight(e["value"])),
    )
    from_scalar = F.array(named(F.try_variant_get(cell, "$", "string"), F.lit(0), no_weight))
    themes = (
        F.when(listed.isNotNull(), from_list).when(kind == "OBJECT", from_map).when(kind == "STRING", from_scalar)
    )
    themes = F.array_sort(F.filter(F.coalesce(themes, F.array().cast("array<struct<order:double,pos:int,label:string,weight:double>>")),
                                   lambda t: t["label"] != ""))
    return (
        cells.withColumn("themes", themes)
        .select("story_id", "slug", "name", F.size("themes").alias("theme_count"),
                F.posexplode_outer("themes").alias("at", "t"))
        .select("story_id", "slug", "name", "theme_count", (F.col("at") + 1).alias("theme_no"),
                F.col("t.label").alias("theme"), F.col("t.weight").alias("weight"))
    )


def outlet_evidence(articles: DataFrame, outlets: DataFrame, analysis: DataFrame) -> DataFrame:
    """Trimmed evidence snippets per (story, outlet); order (published_at, article_id, pos)."""
    return (
        articles.where("story_id is not null")
        .select("story_id", "article_id", "outlet_id", "published_at")
        .join(analysis.select("article_id", "evidence_snippets"), "article_id")
        .join(outlets.select("outlet_id", "slug"), "outlet_id")
        .select("story_id", "slug", "published_at", "article_id", F.posexplode("evidence_snippets").alias("pos", "raw"))
        .select("story_id", "slug", "published_at", "article_id", "pos", text.blank_to_null(F.col("raw")).alias("snippet"))
        .where("snippet is not null")
    )


def top_themes_per_outlet(emphasis: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` themes per outlet without the zero-weight ones."""
    shown = W.partitionBy("story_id", "slug").orderBy("theme_no")
    return (
        emphasis.where(F.col("theme").isNotNull() & (F.col("weight").isNull() | (F.col("weight") > 0)))
        .withColumn("shown_no", F.row_number().over(shown))
        .where(F.col("shown_no") <= n)
        .select("story_id", "slug", "name", "shown_no", "theme", "weight")
    )


def evidence_preview(evidence: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` snippets per (story, outlet)."""
    order = W.partitionBy("story_id", "slug").orderBy("published_at", "article_id", "pos")
    return evidence.withColumn("shown_no", F.row_number().over(order)).where(F.col("shown_no") <= n)


def coverage_gaps(comparisons: DataFrame, articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """(story, outlet, item) of facts an outlet left out; only stories with any item."""
    cells = _outlet_names(_json_cells(comparisons, "not_present_here"), articles, outlets)
    cell = F.col("cell")
    kind = _kind(cell)
    listed = F.coalesce(F.when(kind == "ARRAY", cell), F.when(kind == "OBJECT", _inner_list(cell, ("items", "themes", "points", "highlights"))))

    def readable(v: Column) -> Column:
        plain = F.try_variant_get(v, "$", "string")
        return (
            F.when(_kind(v) == "STRING", text.strip(plain))
            .when(_kind(v) == "VOID", F.lit("null"))
            .when(_kind(v).isin("OBJECT", "ARRAY"), F.to_json(v))
            .otherwise(plain)
        )

    def bare(v: Column) -> Column:
        return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))

    pairs = F.transform(
        F.map_entries(F.try_variant_get(cell, "$", "map<string,variant>")),
        lambda e: F.concat(text.title_from_key(e["key"]), F.lit(": "), bare(e["value"])),
    )
    items = (
        F.when(listed.isNotNull(), F.filter(F.transform(F.try_variant_get(listed, "$", "array<variant>"), readable), lambda s: s != ""))
        .when(kind == "OBJECT", pairs)
        .when(kind == "VOID", F.array().cast("array<string>"))
        .otherwise(F.filter(F.array(readable(cell)), lambda s: s != ""))
    )
    return cells.select("story_id", "slug", "name", F.posexplode_outer(items).alias("pos", "item")).where("item is not null")


# --- sources, quotes, entities --------------------------------------------------------

def source_distribution(articles: DataFrame, outlets: DataFrame, analysis: DataFrame) -> DataFrame:
    """Per (story, outlet): sums of the seven source categories and their total."""
    n = numbers.half_up_int(F.greatest(F.col("value").cast("double"), F.lit(0.0)))
    grouped = (
        _story_analysis(articles, None, analysis, "source_distribution", how="left")
        .select("story_id", "outlet_id", F.explode_outer("source_distribution").alias("key", "value"))
        .select("story_id", "outlet_id", labels.source_category(F.col("key")).alias("category"),
                F.when(~F.isnan("value"), n).alias("n"))
        .groupBy("story_id", "outlet_id")
        .agg(
            *[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("n"))), F.lit(0).cast("long")).alias(c) for c in C.SOURCE_CATEGORIES],
            F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total"),
        )
    )
    return grouped.join(outlets.select("outlet_id", "slug", "name"), "outlet_id").select(
        "story_id", "slug", "name", *C.SOURCE_CATEGORIES, "total"
    )


def source_totals(distribution: DataFrame) -> DataFrame:
    """Per story and category: total, share of the story in per cent, place by total."""
    sums = distribution.groupBy("story_id").agg(
        *[F.sum(c).alias(c) for c in C.SOURCE_CATEGORIES], F.sum("total").alias("grand_total")
    )
    # The order is taken inside the row: larger totals first, then category order.
    entries = F.array_sort(
        F.array(*[
            F.struct((-F.col(c)).alias("neg"), F.lit(i).alias("i"), F.lit(c).alias("category"), F.col(c).alias("n"))
            for i, c in enumerate(C.SOURCE_CATEGORIES)
        ])
    )
    share = F.when(F.col("grand_total") > 0, F.try_divide(F.col("e.n"), F.col("grand_total")) * 100).otherwise(F.lit(0.0))
    return sums.select("story_id", "grand_total", F.posexplode(entries).alias("at", "e")).select(
        "story_id", "grand_total", (F.col("at") + 1).alias("place"), F.col("e.category").alias("category"), F.col("e.n").alias("n"), share.alias("share_pct")
    )


def outlet_source_shares(distribution: DataFrame) -> DataFrame:
    """Per (story, outlet, category) with any source: share of the outlet's total in per cent."""
    entries = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in C.SOURCE_CATEGORIES])
    return distribution.select("story_id", "slug", "total", F.inline(entries)).where("n > 0").select(
        "story_id", "slug", "category", "n", (F.col("n") / F.col("total") * 100).alias("share_pct")
    )


def quoted_sources(articles: DataFrame, outlets: DataFrame, analysis: DataFrame) -> DataFrame:
    """Clean quotes of every story; order (article_id, pos)."""
    bare = text.strip(F.btrim(text.strip(F.col("q.quote")), F.lit(C.QUOTE_MARKS)))
    return (
        _story_analysis(articles, outlets, analysis, "quoted_sources")
        .select("story_id", "slug", "name", "article_id", F.posexplode("quoted_sources").alias("pos", "q"))
        .where(text.blank_to_null(F.col("q.quote")).isNotNull())
        .select(
            "story_id", "slug", "name", "article_id", "pos",
            F.coalesce(text.blank_to_null(F.col("q.speaker")), F.lit(C.NO_SPEAKER)).alias("speaker"),
            text.blank_to_null(F.col("q.affiliation")).alias("affiliation"),
            bare.alias("quote"),
            labels.quote_stance(F.col("q.stance")).alias("stance"),
        )
    )


def entity_rollup(articles: DataFrame, analysis: DataFrame) -> DataFrame:
    """Distinct entities per story and kind, ignoring case; the first-seen spelling wins.

    First seen means (published_at, article_id, position).
    """
    rows = (
        articles.where("story_id is not null").select("story_id", "article_id", "published_at")
        .join(analysis.select("article_id", "entities"), "article_id")
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"entities.{k}").alias("names")) for k in C.ENTITY_KINDS])
    flat = (
        rows.select("story_id", "article_id", "published_at", F.inline(kinds))
        .select("story_id", "article_id", "published_at", "kind", F.posexplode("names").alias("pos", "raw"))
        .select("story_id", "article_id", "published_at", "kind", "pos", text.blank_to_null(F.col("raw")).alias("entity"))
        .where("entity is not null")
    )
    first = F.min(F.struct("published_at", "article_id", "pos", "entity"))
    return (
        flat.groupBy("story_id", "kind", F.lower("entity").alias("folded"))
        .agg(first.alias("f"), F.count(F.lit(1)).alias("mentions"))
        .select("story_id", "kind", F.col("f.entity").alias("entity"), F.col("f.article_id").alias("first_article"),
                F.col("f.pos").alias("first_pos"), "mentions")
    )


def articles_by_outlet(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """Articles of each (story, outlet); outlets by newest article then name, articles newest first.

    ``outlet_newest``, ``name``, ``published_at`` and ``article_id`` carry the order.
    """
    rows = articles.where("story_id is not null").select("story_id", "outlet_id", "article_id", "published_at", "headline")
    newest = rows.groupBy("story_id", "outlet_id").agg(
        F.max("published_at").alias("outlet_newest"), F.count(F.lit(1)).alias("outlet_articles")
    )
    return rows.join(newest, ["story_id", "outlet_id"], "inner").join(
        outlets.select("outlet_id", "slug", "name", "website"), "outlet_id"
    )


def framing_label_norm(analysis: DataFrame) -> DataFrame:
    """Analyses with the folded framing label and readable theme names."""
    return analysis.select(
        "article_id",
        labels.framing_label(F.col("framing_label")).alias("label"),
        F.transform("key_themes", lambda t: text.title_from_key(text.strip(t))).alias("themes"),
    )
