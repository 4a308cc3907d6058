"""Fair top-k selectors: what to enrich, what to compare, what to sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pressgrid import constants as C
from pressgrid.operators.filters import bounded
from pressgrid.operators.dashboards import since


def enrich_candidates(
    articles: DataFrame, outlets: DataFrame, stories: DataFrame, comparisons: DataFrame, as_of: Column,
    limit: int = C.ENRICH_LIMIT, cap: int = C.ENRICH_PER_STORY, top_n: int = C.HOME_TOP_STORIES,
    min_outlets: int = 2, story_ids: DataFrame | None = None,
) -> DataFrame:
    """Home-priority picker of clustered articles.

    At most ``cap`` articles per story, spread over its outlets, newest first;
    stories on the home page first, then stories already compared, then the
    rest.  Only stories with ``min_outlets`` outlets count.  Both ranks are cut
    at ``cap``, so a hot story or outlet is reduced before it is shuffled: an
    article beyond rank ``cap`` in its outlet has ``cap`` articles of the same
    outlet in front of it in the story too.
    """
    if story_ids is not None:
        articles = articles.join(story_ids, "story_id", "left_semi")
        stories = stories.join(story_ids, "story_id", "left_semi")
    covered = articles.where(
        F.col("story_id").isNotNull() & F.col("processing_state").isin("clustered", "analyzed", "complete")
    )
    coverage = covered.groupBy("story_id").agg(
        F.count_distinct("outlet_id").alias("n_outlets"),
        F.count(F.lit(1)).alias("n_articles"),
        F.max("published_at").alias("latest_published"),
    ).where(F.col("n_outlets") >= min_outlets)
    home = (
        stories.where(F.col("last_seen_at") >= since(as_of, hours=C.HOME_FRESH_HOURS))
        .select("story_id", "last_seen_at")
        .join(coverage, "story_id")
        .orderBy(F.desc("n_outlets"), F.desc("n_articles"), F.desc("last_seen_at"), F.desc("story_id"))
        .limit(top_n)
        .select("story_id", F.lit(True).alias("on_home"))
    )
    waiting = articles.where(
        (F.col("processing_state") == "clustered") & (F.col("attempt_count") < C.MAX_ATTEMPTS) & F.col("story_id").isNotNull()
    ).select("story_id", "outlet_id", "article_id", "published_at")
    in_outlet = W.partitionBy("story_id", "outlet_id").orderBy(F.desc("published_at"), "article_id")
    in_story = W.partitionBy("story_id").orderBy("outlet_rank", F.desc("published_at"), "article_id")
    ranked = (
        waiting.withColumn("outlet_rank", F.row_number().over(in_outlet))
        .where(F.col("outlet_rank") <= cap)
        .withColumn("story_rank", F.row_number().over(in_story))
        .where(F.col("story_rank") <= cap)
    )
    tier = F.when(F.col("on_home"), 0).when(F.col("compared"), 1).otherwise(2)
    return (
        ranked.join(coverage, "story_id")
        .join(F.broadcast(home), "story_id", "left")  # top_n rows
        .join(comparisons.select("story_id", F.lit(True).alias("compared")), "story_id", "left")
        .withColumn("tier", tier)
        .orderBy("tier", F.desc("n_outlets"), F.desc("n_articles"), F.desc("latest_published"), "story_rank", "article_id")
        .limit(limit)
        .join(outlets.select("outlet_id", F.col("slug").alias("outlet_slug")), "outlet_id")
        .select("article_id", "outlet_slug", "story_id", "tier", "story_rank", "n_outlets", "n_articles")
    )


def compare_candidates(
    articles: DataFrame, comparisons: DataFrame, limit: int | None = C.COMPARE_LIMIT, story_ids: DataFrame | None = None
) -> DataFrame:
    """Stories due for a (new) comparison, lowest id first.

    Two analysed articles of two outlets are needed, and either no comparison
    yet or an article analysed after the last one.
    """
    ready = articles.where(F.col("story_id").isNotNull() & F.col("processing_state").isin("analyzed", "complete"))
    if story_ids is not None:
        ready = ready.join(story_ids, "story_id", "left_semi")
    stats = ready.groupBy("story_id").agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.count_distinct("outlet_id").alias("n_outlets"),
        F.max(F.when(F.col("processing_state") == "analyzed", F.col("state_updated_at"))).alias("latest_analyzed_at"),
    ).where((F.col("n_articles") >= C.COMPARE_MIN_ARTICLES) & (F.col("n_outlets") >= C.COMPARE_MIN_OUTLETS))
    due = F.col("generated_at").isNull() | (F.col("latest_analyzed_at") > F.col("generated_at"))
    rows = stats.join(comparisons.select("story_id", "generated_at"), "story_id", "left").where(due)
    return rows if limit is None else rows.orderBy("story_id").limit(limit)


def story_context(articles: DataFrame, outlets: DataFrame, analysis: DataFrame, story_ids: DataFrame | None = None) -> DataFrame:
    """One JSON record per analysed article of each story; order (story_id, article_id).

    Records stay rows: a writer or a request builder streams them in order, and
    a hot story is never gathered into one value.
    """
    ready = articles.where(F.col("story_id").isNotNull() & F.col("processing_state").isin("analyzed", "complete"))
    if story_ids is not None:
        ready = ready.join(story_ids, "story_id", "left_semi")
    record = F.to_json(
        F.struct(
            F.col("slug").alias("outlet_slug"), "article_id", "headline",
            F.col("framing_score").cast("double").alias("framing_score"), "framing_label",
            F.col("framing_confidence").cast("double").alias("framing_confidence"),
            F.coalesce("key_themes", F.array().cast("array<string>")).alias("key_themes"),
            "entities", "quoted_sources", "evidence_snippets",
        ),
        {"ignoreNullFields": "false"},
    )
    return (
        ready.select("story_id", "article_id", "outlet_id", "headline")
        .join(analysis.drop("analysis_run_id", "analyzed_at"), "article_id")
        .join(outlets.select("outlet_id", "slug"), "outlet_id")
        .select("story_id", "article_id", "slug", F.col("framing_score").cast("double").alias("framing_score"), record.alias("record"))
    )


def diverse_sample(
    articles: DataFrame, outlets: DataFrame, target: int = 20, top_stories: int = 4, per_story: int = 3, pool: int = 200
) -> DataFrame:
    """A small sample spread over stories and outlets.

    First the newest article of up to ``per_story`` outlets in each of the ``top_stories`` broadest
    stories, then the ``pool`` most recent other articles, least-represented outlet first.  The
    second step picks one article at a time from the outlet with the fewest
    picks; that equals sorting by (picks so far + turn in outlet - 1, newest id).
    """
    for name, value, most in (("top_stories", top_stories, 40), ("per_story", per_story, 40), ("pool", pool, 2000)):
        bounded(name, value, most)
    usable = articles.where(
        (F.col("processing_state") == "clustered") & (F.length(F.coalesce("full_text", F.lit(""))) > 0)
    ).select("article_id", "story_id", "outlet_id", "published_at")
    big = (
        usable.where("story_id is not null").groupBy("story_id")
        .agg(F.count(F.lit(1)).alias("n_articles"), F.count_distinct("outlet_id").alias("n_outlets"))
        .where("n_outlets >= 2")
        .orderBy(F.desc("n_outlets"), F.desc("n_articles"), F.desc("story_id"))
        .limit(top_stories)
    )
    newest = (
        usable.join(F.broadcast(big), "story_id")  # top_stories rows
        .groupBy("story_id", "outlet_id", "n_outlets", "n_articles")
        .agg(F.max(F.struct("published_at", (-F.col("article_id")).alias("neg_id"))).alias("best"))
        .select("story_id", "outlet_id", "n_outlets", "n_articles", (-F.col("best.neg_id")).alias("article_id"))
        .withColumn("outlet_no", F.row_number().over(W.partitionBy("story_id").orderBy("outlet_id")))
        .where(F.col("outlet_no") <= per_story)
    )
    first = (
        newest.withColumn("pick_no", F.row_number().over(
            W.partitionBy(F.lit(0)).orderBy(F.desc("n_outlets"), F.desc("n_articles"), F.desc("story_id"), "outlet_no")))  # top_stories * per_story rows
        .where(F.col("pick_no") <= target)
        .select("article_id", "outlet_id", "pick_no")
    )
    counts = first.groupBy("outlet_id").agg(F.count(F.lit(1)).alias("base"))
    taken = first.agg(F.count(F.lit(1))).scalar()
    recent = (
        usable.join(F.broadcast(first.select("article_id")), "article_id", "left_anti")  # as few
        .orderBy(F.desc("published_at"), F.desc("article_id"))
        .limit(pool)
    )
    turn = F.row_number().over(W.partitionBy("outlet_id").orderBy(F.desc("article_id")))
    load = F.coalesce("base", F.lit(0)) + turn - 1
    second = (
        recent.join(F.broadcast(counts), "outlet_id", "left")
        .withColumn("load", load)
        .withColumn("pick_no", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("load", F.desc("article_id"))) + taken)  # pool rows
        .where(F.col("pick_no") <= target)
        .select("article_id", "outlet_id", "pick_no")
    )
    return first.unionByName(second).join(outlets.select("outlet_id", "slug"), "outlet_id").select("pick_no", "article_id", "slug")


def unanalyzed_in_sample(sample: DataFrame, analysis: DataFrame) -> DataFrame:
    """Sampled articles without an analysis."""
    return sample.join(analysis.select("article_id"), "article_id", "left_anti")


def foreign_rows_in_run(analysis: DataFrame, sample: DataFrame, run_id: int) -> DataFrame:
    """Analyses of a run that are not of the sample."""
    return analysis.where(F.col("analysis_run_id") == run_id).select("article_id").join(
        sample.select("article_id"), "article_id", "left_anti"
    )
