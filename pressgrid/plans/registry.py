"""Registered queries: operator calls over the bound tables.

Keys are the operator names; every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid import constants as C
from pressgrid.operators import clustering, dashboards, embedding, filters, quality, rolling, search, selection, state, stories, validation
from pressgrid.plans.report import report
from pressgrid.plans.tables import Tables, as_of
from pressgrid.session import folder_done, prepare, run_folder
from pressgrid.stash import stash
from pressgrid.sources import feeds, images, pages, upserts
from pressgrid.streaming import jobs

SEARCH = "onthe then anst"
TEMPLATE = "Outlet: {outlet_slug}\nHeadline: {headline}\nBody:\n{body}"

Build = Callable[[Tables], DataFrame]
QUERIES: dict[str, Build] = {}


def query(name: str):
    def register(build: Build) -> Build:
        QUERIES[name] = build
        return build

    return register


def runner(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return report(build(Tables(prepare(spark), sf_dir)))

    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: runner(build) for name, build in QUERIES.items()}


def add(name: str, build: Build) -> None:
    QUERIES[name] = build


# --- sources and upserts ---------------------------------------------------------

add("feed_entries", lambda t: feeds.feed_entries(t.raw_feeds).drop("fetched_at", "item_no", "image_url"))
add("feed_image_url", lambda t: feeds.feed_entries(t.raw_feeds).select("outlet_slug", "url", "image_url"))
add("feed_health", lambda t: feeds.feed_health(t.raw_feeds))


@query("discover_new_urls")
def _discover(t: Tables) -> DataFrame:
    # Every document is offered twice, once under the address of its neighbour.
    offered = t.articles.select("article_id", "url", "headline", "outlet_id")
    twice = offered.selectExpr(
        "article_id", "headline", "outlet_id",
        "explode(array(url, concat('https://wire.example/', article_id div 3))) as url",
    )
    entries = twice.withColumn("arrival", F.col("article_id"))
    known = t.articles.where("processing_state <> 'discovered'")
    return feeds.discover_new_urls(entries, known)


def _outlet_specs(t: Tables) -> DataFrame:
    return t.outlets.selectExpr(
        "if(outlet_id % 4 = 3, concat('new-', slug), slug) as slug",
        "if(outlet_id % 3 = 1, concat(name, ' News'), name) as name", "rss_url", "website",
    )


add("outlets_upsert_plan", lambda t: upserts.outlets_upsert_plan(_outlet_specs(t), t.outlets).drop("logo_url"))
add("outlets_upsert_counts", lambda t: upserts.action_counts(upserts.outlets_upsert_plan(_outlet_specs(t), t.outlets)))


def _rating_plan(t: Tables) -> DataFrame:
    records = t.outlets.selectExpr(
        "if(outlet_id % 7 = 6, concat('gone-', slug), slug) as outlet_slug",
        "if(outlet_id % 2 = 0, 'MBFC', 'AdFontes') as source",
        """case when outlet_id % 9 = 8 then 'Mostly Odd' when outlet_id % 2 = 0
           then element_at(array('Left-Center', 'Least Biased', 'Right-Center'), cast(outlet_id % 3 + 1 as int))
           else ' Skews Right ' end as original_label""",
        "if(outlet_id % 4 = 0, concat('https://ratings.example/', slug), 'https://ratings.example/moved') as rating_url",
        "timestamp_seconds(1704067200 - 86400 * outlet_id) as rated_at",
    )
    return upserts.bias_ratings_upsert_plan(records, t.outlets, t.ratings)


add("bias_ratings_upsert_plan", _rating_plan)
add("bias_ratings_upsert_counts", lambda t: upserts.action_counts(_rating_plan(t)))


@query("latest_wins_upsert")
def _latest_wins(t: Tables) -> DataFrame:
    # Event streams as versions of a row per user: odd events are the table, even ones arrive.
    rows = t.events.select("user_id", "event_id", "event_type", "value")
    return upserts.latest_wins_upsert(rows.where("event_id % 2 = 1"), rows.where("event_id % 2 = 0"), "user_id", "event_id")


add("article_main_text", lambda t: pages.article_main_text(t.given("pages")))
add("article_main_text_articles", lambda t: pages.article_main_text(t.web_pages).select("page_id", "main_text"))


@query("image_url_clean")
def _image_clean(t: Tables) -> DataFrame:
    raw = t.documents.selectExpr(
        "doc_id",
        "concat('https://', source, '.example/news/', doc_id, '?p=1') as base",
        """case doc_id % 12
             when 0 then concat(' "https://img.example/', doc_id, '.jpg" ')
             when 1 then concat("'//cdn.example/", doc_id, ".png'")
             when 2 then concat('/a/./b/../', doc_id, '.gif')
             when 3 then concat('../', doc_id, '.webp?w=100&h=100')
             when 4 then concat('pic-', doc_id, '.avif#frag')
             when 5 then 'javascript:void(0)'
             when 6 then concat('https://img.example/Favicon-', doc_id, '.ico')
             when 7 then concat('https://img.example/x/ads/', doc_id, '.jpg')
             when 8 then concat('https://img.example/', doc_id, '.jpg?width=64&height=640')
             when 9 then concat('HTTP://img.example/', doc_id, '?W=10&H=20')
             when 10 then '   '
             else 'https:///nohost.jpg' end as link""",
    )
    return images.image_url_clean(raw, "link", "base").select("doc_id", "clean_url")


add("page_image_url", lambda t: images.page_image_url(t.web_pages))
add("page_image_url_given", lambda t: images.page_image_url(t.given("pages")))


def _backfill(t: Tables) -> DataFrame:
    fetched = t.web_pages.withColumnRenamed("page_id", "article_id")
    fetched = fetched.withColumn("html", F.expr("if(article_id % 17 = 3, null, html)"))  # bodies that were lost
    return images.image_backfill(t.articles, fetched, limit=100)


add("image_backfill", _backfill)
add("image_backfill_stats", lambda t: images.image_backfill_stats(_backfill(t)))
add("run_ledger_row", lambda t: state.run_ledger_row(
    t.articles, t.outcomes, t.ingestion_runs, t.articles.select(F.col("processing_state").eqNullSafe("discovered").alias("inserted")),
    dashboards.since(as_of(), hours=1), as_of(), "manual"))
add("run_opened", lambda t: state.open_run(t.ingestion_runs, as_of()))

# --- filters ------------------------------------------------------------------------

add("eligible_batch", lambda t: filters.eligible_batch(t.articles, "extracted").select("article_id", "outlet_id", "url"))
add("eligible_batch_outlet", lambda t: filters.eligible_batch(t.articles, "discovered", 50, outlet_id=0).select("article_id", "url"))


@query("scoped_candidates")
def _scoped(t: Tables) -> DataFrame:
    good = t.given("labels").where("quality = 1").selectExpr("doc_id as article_id")
    return filters.scoped_candidates(t.articles, t.outlets, limit=20, ids=good)


add("active_outlets", lambda t: filters.active_outlets(t.outlets).drop("logo_url"))
add("fresh_stories", lambda t: stories.fresh_stories(t.stories, as_of()).drop("summary"))
add("outlet_by_slug", lambda t: filters.outlet_by_slug(t.outlets, "src7").drop("logo_url"))


def _payload_as_text(rows: DataFrame) -> DataFrame:
    """The nested columns of an analysis as JSON text, null fields included."""
    nested = ("key_themes", "entities", "quoted_sources", "source_distribution", "evidence_snippets")
    return rows.withColumns({c: F.to_json(c, {"ignoreNullFields": "false"}) for c in nested})


add("article_detail", lambda t: _payload_as_text(filters.article_detail(t.articles, t.outlets, t.analysis)))
add("embed_text", lambda t: filters.embed_text(t.articles))
add("enrich_requests", lambda t: filters.enrich_requests(t.articles, t.outlets, TEMPLATE))


def _sample(t: Tables) -> DataFrame:
    return selection.diverse_sample(t.articles, t.outlets)


add("diverse_sample", _sample)
add("unanalyzed_in_sample", lambda t: selection.unanalyzed_in_sample(_sample(t), t.analysis).select("article_id"))
add("foreign_rows_in_run", lambda t: selection.foreign_rows_in_run(t.analysis, _sample(t), 4))

# --- states, embedding, clustering, selection ----------------------------------------

STATE_COLUMNS = ["article_id", "processing_state", "state_updated_at", "state_error", "attempt_count"]
add("apply_outcomes", lambda t: state.apply_outcomes(t.articles, t.outcomes, as_of()).select(*STATE_COLUMNS))
add("apply_llm_outcomes", lambda t: state.apply_llm_outcomes(t.articles, t.outcomes, as_of()).select(*STATE_COLUMNS))


def embedded(t: Tables) -> DataFrame:
    """Articles with their vector, written once like the embed stage does; every fourth is already in a story."""
    texts = t.articles.select(
        "article_id", "published_at", "headline",
        filters.embed_text_of(F.col("headline"), F.col("full_text")).alias("embed_text"),
        F.when(F.col("article_id") % 4 == 0, F.col("story_id")).alias("story_id"),
    )
    return stash(embedding.hash_embedding(texts, "embed_text").drop("embed_text"), "embedded")


@query("hash_embedding")
def _hash_embedding(t: Tables) -> DataFrame:
    texts = t.articles.select("article_id", filters.embed_text_of(F.col("headline"), F.col("full_text")).alias("embed_text"))
    vectors = embedding.hash_embedding(texts, "embed_text")
    return embedding.sparse_components(vectors, "article_id").select(
        "article_id", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


@query("pairwise_cosine")
def _pairwise(t: Tables) -> DataFrame:
    vectors = t.given("embeddings")
    lead = vectors.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("lead"))
    pairs = vectors.join(lead, "label").select(
        "vec_id", "label", F.col("lead.vec_id").alias("lead_id"), "embedding", F.col("lead.embedding").alias("lead_embedding")
    )
    return clustering.pairwise_cosine(pairs, "embedding", "lead_embedding").drop("embedding", "lead_embedding")


add("nearest_predecessor", lambda t: clustering.nearest_predecessor(embedded(t), as_of(), lookback_days=31))
add("nearest_predecessor_lookback", lambda t: clustering.nearest_predecessor(embedded(t), as_of()))
add("assign_stories", lambda t: clustering.assign_stories(embedded(t), as_of(), lookback_days=31))
add("assign_stories_lookback", lambda t: clustering.assign_stories(embedded(t), as_of()))


@query("assign_stories_vectors")
def _assign_vectors(t: Tables) -> DataFrame:
    vectors = t.given("embeddings").selectExpr(
        "vec_id as article_id", "embedding", "cast(null as bigint) as story_id",
        "timestamp_seconds(1704067200 + 60 * ((vec_id * 7919) % 43200)) as published_at",
    )
    return clustering.assign_stories(vectors, as_of(), lookback_days=31, threshold=0.40)


@query("story_rollup")
def _rollup(t: Tables) -> DataFrame:
    articles = embedded(t)
    assigned = clustering.assign_stories(articles, as_of(), lookback_days=31)
    # New stories get negative ids here, so that they cannot meet existing ones.
    ids = assigned.selectExpr("article_id", "if(is_new_story, -story_id - 1, story_id) as assigned_id")
    merged = articles.drop("embedding").join(ids, "article_id", "left").selectExpr(
        "article_id", "published_at", "headline", "coalesce(assigned_id, story_id) as story_id"
    )
    return clustering.story_rollup(merged)


def _enrich_args(t: Tables):
    return t.articles, t.outlets, t.stories, t.stored_comparisons, as_of()


add("enrich_candidates", lambda t: selection.enrich_candidates(*_enrich_args(t)))


def _some_stories(t: Tables) -> DataFrame:
    return t.stories.where("topic in ('topic_1', 'topic_2')").select("story_id")


add("enrich_candidates_scoped", lambda t: selection.enrich_candidates(*_enrich_args(t), story_ids=_some_stories(t)))
add("compare_candidates", lambda t: selection.compare_candidates(t.articles, t.stored_comparisons))
add("compare_candidates_scoped", lambda t: selection.compare_candidates(t.articles, t.stored_comparisons, story_ids=_some_stories(t)))


@query("validate_enrichment")
def _validate_enrichment(t: Tables) -> DataFrame:
    answers = t.documents.selectExpr(
        "doc_id as article_id",
        r"""case doc_id % 14
              when 0 then 'I cannot answer'
              when 1 then '[1, 2]'
              else concat('{"framing_score":', case when doc_id % 14 = 2 then '1.5' when doc_id % 14 = 3 then '"high"' when doc_id % 14 = 13 then '"0.25"'
                     else cast(((doc_id * 37) % 201 - 100) / 100 as string) end,
                ',"framing_label":"', if(doc_id % 14 = 4, 'angry', 'neutral'),
                '","framing_confidence":', if(doc_id % 14 = 5, '-0.1', '0.5'),
                ',"headline_sentiment":0,"body_sentiment":', if(doc_id % 14 = 6, 'null', '-1'),
                if(doc_id % 14 = 7, ',"extra":1', ''),
                ',"entities":{"people":["A",', if(doc_id % 14 = 8, '5', '"B"'), ']}',
                ',"quoted_sources":[{"speaker":"S","quote":"Q ', doc_id, '","stance":"', if(doc_id % 14 = 9, 'angry', 'supports'), '"}]',
                ',"source_distribution":{"expert":', if(doc_id % 14 = 10, '-2', '2'), if(doc_id % 14 = 11, ',"bloggers":1', ''), '}',
                if(doc_id % 14 = 12, '', concat(',"key_themes":["', lang, '","x"],"evidence_snippets":["e', doc_id, '"]')), '}') end as response""",
    )
    return validation.validate_enrichment(answers).selectExpr(
        "article_id", "is_valid", "reason", "framing_score", "framing_label", "body_sentiment", "key_themes",
        "entities.people as people", "quoted_sources.quote as quotes", "source_distribution.expert as expert",
        "source_distribution.other as other", "evidence_snippets",
    )


@query("validate_comparison")
def _validate_comparison(t: Tables) -> DataFrame:
    answers = t.stories.selectExpr(
        "story_id",
        """case story_id % 9
             when 0 then 'not json'
             when 1 then '{"differences":"  "}'
             when 2 then '{"differences":"d","coverage_matrix":{"a":{"x":1.2}}}'
             when 3 then '{"differences":"d","coverage_matrix":{"a":[1]}}'
             when 4 then '{"differences":"d","not_present_here":{"a":"fact"}}'
             when 5 then '{"differences":"d","spread":0.1}'
             when 6 then '{"differences":"d"}'
             else concat('{"differences":"- story ', story_id, '","coverage_matrix":{"a":{"x":0.5,"y":"0.25"},"b":{}},"not_present_here":{"b":["f1","f2"]}}')
           end as response""",
    )
    return validation.validate_comparison(answers).selectExpr(
        "story_id", "is_valid", "reason", "differences", "coverage_matrix['a']['x'] as a_x", "coverage_matrix['a']['y'] as a_y",
        "not_present_here['b'] as b_gaps",
    )


@query("story_context")
def _context(t: Tables) -> DataFrame:
    rows = selection.story_context(t.articles, t.outlets, t.analysis)
    return rows.select(
        "story_id", "article_id", "slug", "framing_score",
        F.get_json_object("record", "$.headline").alias("headline"),
        F.get_json_object("record", "$.key_themes[1]").alias("second_theme"),
        F.get_json_object("record", "$.quoted_sources[0].quote").alias("first_quote"),
    )


add("theme_union", lambda t: stories.theme_union(t.articles, t.analysis))
add("framing_spread", lambda t: stories.framing_spread(t.articles, t.analysis))


@query("compare_requests")
def _compare_requests(t: Tables) -> DataFrame:
    context = selection.story_context(t.articles, t.outlets, t.analysis)
    return filters.compare_requests(context, t.stories, stories.theme_union(t.articles, t.analysis))


@query("advance_compared")
def _advance_compared(t: Tables) -> DataFrame:
    compared = t.stored_comparisons.select("story_id")
    return state.advance_compared(t.articles, compared, as_of()).select(*STATE_COLUMNS)


# --- dashboards -----------------------------------------------------------------------

add("overview_counts", lambda t: dashboards.overview_counts(t.articles, t.stories, t.outlets, as_of()))
add("articles_by_state", lambda t: dashboards.articles_by_state(t.articles))
add("framing_distribution_all", lambda t: dashboards.framing_distribution_all(t.analysis))
add("latest_ingestion_run", lambda t: dashboards.latest_ingestion_run(t.ingestion_runs))
add("analysed_pct", lambda t: dashboards.analysed_pct(t.articles))
add("articles_per_day", lambda t: dashboards.articles_per_day(t.articles, as_of(), 7))
add("stories_per_day", lambda t: dashboards.stories_per_day(t.stories, as_of(), 7))
add("framing_distribution_window", lambda t: dashboards.framing_distribution_window(t.articles, t.analysis, as_of(), 7))
add("trend_series", lambda t: dashboards.trend_series(t.articles, t.stories, as_of(), 30))
add("trend_totals", lambda t: dashboards.trend_totals(dashboards.trend_series(t.articles, t.stories, as_of(), 30)))
add("framing_partition", lambda t: dashboards.framing_partition(dashboards.framing_distribution_window(t.articles, t.analysis, as_of(), 7)))
add("outlet_30d_stats", lambda t: dashboards.outlet_30d_stats(t.articles, t.analysis, as_of()))


_DAILY_FOLDERS: dict[tuple[str, str], str] = {}


@query("outlet_30d_stored")
def _outlet_30d_stored(t: Tables) -> DataFrame:
    # Yesterday's window, moved by a day.  The days are stored once per application and data folder.
    folder = _DAILY_FOLDERS.setdefault((t.spark.sparkContext.applicationId, t.path("documents")), run_folder(t.spark, "outlet-days"))
    fresh = not folder_done(t.spark, folder)
    stored = rolling.DailyOutletStats(t.spark, folder)
    if fresh:
        stored.refresh(t.articles, t.analysis)
    today = date(2024, 1, 31)
    yesterday = today - timedelta(days=1)
    return rolling.window_stats(stored.moved(stored.window(yesterday), yesterday, today))


add("outlet_theme_counts", lambda t: dashboards.outlet_theme_counts(t.articles, t.analysis, as_of()))
add("outlet_stats", lambda t: dashboards.outlet_stats(t.outlets, dashboards.outlet_averages(t.articles, t.analysis, as_of(), 3)))
add("outlet_directory", lambda t: dashboards.outlet_directory(t.outlets, t.ratings))

# --- stories ----------------------------------------------------------------------------

add("stories_page", lambda t: stories.stories_page(t.stories, t.articles, t.outlets, t.comparisons, as_of(), page=2))
add("stories_page_fresh", lambda t: stories.stories_page(t.stories, t.articles, t.outlets, t.comparisons, as_of(), fresh=True))
add("story_detail", lambda t: _payload_as_text(stories.story_detail(t.stories, t.articles, t.outlets, t.analysis, t.comparisons)))


@query("story_header")
def _story_header(t: Tables) -> DataFrame:
    # The weights inside the matrix are compared by outlet_emphasis; here its outlets stand for it.
    shown = {
        "coverage_matrix": F.array_sort(F.json_object_keys("coverage_matrix")),
        "story_images": F.transform("story_images", lambda x: F.concat_ws(" ", x["rank_no"], x["article_id"], x["slug"], x["name"], x["url"])),
        "bias_sources": F.transform(
            "bias_sources",
            lambda x: F.concat_ws(" ", x["outlet_id"], x["slug"], x["name"], x["original_label"], x["category"], x["source"], x["rating_url"],
                                  F.date_format(x["rated_at"], "yyyy-MM-dd HH:mm:ss")),
        ),
    }
    return stories.story_header(t.stories, t.articles, t.outlets, t.comparisons, t.ratings).withColumns(shown)


add("story_sentiment_agg", lambda t: stories.story_sentiment_agg(t.stories, t.articles, t.analysis, as_of()))
add("positive_story_reasons", lambda t: stories.positive_story_reasons(
    stories.story_sentiment_agg(t.stories, t.articles, t.analysis, as_of(), days=30), as_of()))
add("positive_stories", lambda t: stories.positive_stories(t.stories, t.articles, t.outlets, t.analysis, t.comparisons, as_of()).drop("summary"))
add("bias_distribution", lambda t: stories.bias_distribution(t.articles, t.outlets, t.ratings))
add("bias_distribution_two_sources", lambda t: stories.bias_distribution(t.articles, t.outlets, t.ratings, ("AdFontes", "MBFC")))
add("bias_sources", lambda t: stories.bias_sources(t.articles, t.outlets, t.ratings))


@query("normalize_label")
def _normalize_label(t: Tables) -> DataFrame:
    from pressgrid.functions import labels

    return t.ratings.select(
        "outlet_id", "source", "original_label",
        labels.bias_category(F.concat(F.lit(" "), "source"), F.concat(F.upper("original_label"), F.lit(" "))).alias("category"),
    )


add("story_images", lambda t: stories.story_images(t.articles, t.outlets, t.stories))
add("home_sections", lambda t: stories.home_sections(t.stories, t.articles, t.outlets, as_of()))
add("framing_by_outlet", lambda t: stories.framing_by_outlet(t.articles, t.outlets, t.analysis))
add("framing_spread_nullable", lambda t: stories.framing_spread_nullable(t.articles, t.analysis))
add("outlet_emphasis", lambda t: stories.outlet_emphasis(t.comparisons, t.articles, t.outlets))
add("outlet_evidence", lambda t: stories.outlet_evidence(t.articles, t.outlets, t.analysis))
add("top_themes_per_outlet", lambda t: stories.top_themes_per_outlet(stories.outlet_emphasis(t.comparisons, t.articles, t.outlets)))
add("evidence_preview", lambda t: stories.evidence_preview(stories.outlet_evidence(t.articles, t.outlets, t.analysis)))
add("coverage_gaps", lambda t: stories.coverage_gaps(t.comparisons, t.articles, t.outlets))
add("source_distribution", lambda t: stories.source_distribution(t.articles, t.outlets, t.analysis))
add("source_totals", lambda t: stories.source_totals(stories.source_distribution(t.articles, t.outlets, t.analysis)))
add("outlet_source_shares", lambda t: stories.outlet_source_shares(stories.source_distribution(t.articles, t.outlets, t.analysis)))
add("quoted_sources", lambda t: stories.quoted_sources(t.articles, t.outlets, t.analysis))
add("entity_rollup", lambda t: stories.entity_rollup(t.articles, t.analysis))
add("articles_by_outlet", lambda t: stories.articles_by_outlet(t.articles, t.outlets))
add("framing_label_norm", lambda t: stories.framing_label_norm(
    t.analysis.withColumn("framing_label", F.concat(F.lit(" "), F.initcap("framing_label")))))

# --- search -------------------------------------------------------------------------------

add("fts_tokens", lambda t: search.fts_tokens(t.articles))


# Index folder by application and data folder: written once, then read by every search.
_INDEX_FOLDERS: dict[tuple[str, str], str] = {}


def _search_index(t: Tables) -> search.SearchIndex:
    key = (t.spark.sparkContext.applicationId, t.path("documents"))
    folder = _INDEX_FOLDERS.setdefault(key, run_folder(t.spark, "search-index"))
    return search.build_index(t.articles, folder)


add("search_match", lambda t: search.search_match(_search_index(t), SEARCH))
add("search_total", lambda t: search.search_total(_search_index(t), SEARCH))
add("search_ranked", lambda t: search.search_ranked(_search_index(t), t.articles, t.outlets, SEARCH))
add("search_snippet", lambda t: search.search_snippet(t.articles, SEARCH))

# --- quality and reports --------------------------------------------------------------------

add("analysis_quality", lambda t: quality.analysis_quality(
    t.analysis.withColumn("framing_score", F.when(F.col("article_id") % 50 == 7, F.lit(1.5)).otherwise(F.col("framing_score").cast("double")))
    .withColumn("framing_label", F.when(F.col("article_id") % 31 == 4, "left").otherwise(F.col("framing_label")))))
add("grounding_per_article", lambda t: quality.grounding_per_article(t.articles, t.analysis))
add("grounding_rate", lambda t: quality.grounding_rate(quality.grounding_per_article(t.articles, t.analysis)))
add("grounding_normalize", lambda t: quality.grounding_normalize(t.articles))
add("run_report", lambda t: quality.run_report(t.articles, t.outlets, t.analysis))
add("run_touched_articles", lambda t: quality.run_touched_articles(t.articles, t.analysis_runs))
add("outlet_article_counts", lambda t: quality.outlet_article_counts(t.outlets, t.articles))
add("recent_runs", lambda t: quality.recent_runs(t.ingestion_runs))
add("top_stories", lambda t: quality.top_stories(t.stories, t.articles, t.outlets))
add("story_stats", lambda t: quality.story_stats(t.stories))
add("recent_articles", lambda t: quality.recent_articles(t.articles, t.outlets))
add("failed_articles", lambda t: quality.failed_articles(t.articles, t.outlets))
add("completeness", lambda t: quality.completeness(
    t.articles, t.articles.where("processing_state not in ('discovered', 'extracted', 'failed_extract')").select("article_id")))
add("constraint_violations", lambda t: quality.constraint_violations(
    t.articles, t.outlets, t.stories.withColumn("story_id", F.expr("if(story_id % 25 = 24, -story_id, story_id)")), t.analysis, t.comparisons, t.ratings, t.ingestion_runs,
    # One run is missing and one has a purpose that is not allowed.
    t.analysis_runs.where("analysis_run_id <> 5").withColumn("purpose", F.expr("if(analysis_run_id = 3, 'audit', purpose)"))))

# --- streaming ------------------------------------------------------------------------------

add("stream_discover", jobs.query_discover)
add("stream_daily_counts", jobs.query_daily_counts)
add("stream_cluster", jobs.query_cluster)
add("stream_latest_wins", jobs.query_latest_wins)
add("stream_attempts", jobs.query_attempts)
add("stream_recompare", jobs.query_recompare)
