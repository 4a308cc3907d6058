"""Data-quality audits and operational reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid import constants as C
from pressgrid.functions import text
from pressgrid.operators.filters import bounded


def analysis_quality(analysis: DataFrame, run_id: int | None = None) -> DataFrame:
    """Counts of rule breaks over one run (or all), and articles analysed twice."""
    rows = analysis if run_id is None else analysis.where(F.col("analysis_run_id") == run_id)

    def outside(name: str, low: float) -> Column:
        return (F.col(name) < low) | (F.col(name) > 1)

    twice = analysis.groupBy("article_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)))
    return rows.agg(
        F.count_if(outside("framing_score", -1)).alias("out_of_range_framing_score"),
        F.count_if(outside("framing_confidence", 0)).alias("out_of_range_confidence"),
        F.count_if(outside("headline_sentiment", -1) | outside("body_sentiment", -1)).alias("out_of_range_sentiment"),
        F.count_if(~F.col("framing_label").isin(*C.FRAMING_LABELS)).alias("invalid_framing_label"),
    ).withColumn("duplicate_article_analysis", twice.scalar())


def grounding_per_article(articles: DataFrame, analysis: DataFrame) -> DataFrame:
    """Evidence snippets and quotes found in the folded whole body, per analysed article."""
    folded = (
        analysis.select("article_id", "analysis_run_id", "evidence_snippets", "quoted_sources")
        .join(articles.select("article_id", "full_text"), "article_id")
        .select(
            "article_id", "analysis_run_id",
            F.coalesce("evidence_snippets", F.array().cast("array<string>")).alias("evidence"),
            F.coalesce(F.col("quoted_sources.quote"), F.array().cast("array<string>")).alias("quotes"),
            text.fold_for_grounding(F.col("full_text")).alias("body"),
        )
    )

    def found(snippet: Column) -> Column:
        return (F.coalesce(snippet, F.lit("")) != "") & F.contains(F.col("body"), text.fold_for_grounding(snippet))

    return folded.select(
        "article_id", "analysis_run_id",
        F.size("evidence").cast("long").alias("evidence_total"),
        F.size(F.filter("evidence", found)).cast("long").alias("evidence_grounded"),
        F.size("quotes").cast("long").alias("quotes_total"),
        F.size(F.filter("quotes", found)).cast("long").alias("quotes_grounded"),
    )


def grounding_rate(per_article: DataFrame) -> DataFrame:
    """Totals and rates; a rate without anything to check is null."""
    sums = per_article.agg(
        *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c)
          for c in ("evidence_total", "evidence_grounded", "quotes_total", "quotes_grounded")]
    )
    return sums.select(
        "*",
        F.try_divide("evidence_grounded", "evidence_total").alias("evidence_rate"),
        F.try_divide("quotes_grounded", "quotes_total").alias("quotes_rate"),
    )


def grounding_normalize(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", text.fold_for_grounding(F.col("full_text")).alias("folded"))


def run_report(articles: DataFrame, outlets: DataFrame, analysis: DataFrame, run_id: int | None = None) -> DataFrame:
    """Per analysis of a run: sizes of its lists and the first item of each."""
    rows = analysis if run_id is None else analysis.where(F.col("analysis_run_id") == run_id)
    entities = sum((F.size(F.coalesce(f"entities.{k}", F.array().cast("array<string>"))) for k in C.ENTITY_KINDS[1:]),
                   F.size(F.coalesce(f"entities.{C.ENTITY_KINDS[0]}", F.array().cast("array<string>"))))

    def count(name: str) -> Column:
        return F.greatest(F.size(name), F.lit(0)).cast("long")

    return (
        rows.join(articles.select("article_id", "headline", "outlet_id"), "article_id")
        .join(outlets.select("outlet_id", "slug"), "outlet_id")
        .select(
            "analysis_run_id", "article_id", "slug", "headline",
            F.col("framing_score").cast("double").alias("framing_score"), "framing_label",
            count("key_themes").alias("theme_count"), count("quoted_sources").alias("quote_count"),
            count("evidence_snippets").alias("evidence_count"), entities.cast("long").alias("entity_count"),
            F.try_element_at("key_themes", F.lit(1)).alias("first_theme"),
            F.try_element_at("evidence_snippets", F.lit(1)).alias("first_evidence"),
            F.try_element_at("quoted_sources", F.lit(1))["speaker"].alias("first_speaker"),
        )
    )


def run_touched_articles(articles: DataFrame, runs: DataFrame, minutes: int = 30) -> DataFrame:
    """Articles whose state moved within ``minutes`` of each run, counted by state.

    The range condition becomes an equality on time bins: an article falls in
    one bin, a run reaches from its own bin into the next, so the join shuffles
    on (bin) and never compares all runs with all articles.  The articles are
    first counted by (bin, instant, state), which shrinks a hot bin.
    """
    width = minutes * 60
    moves = (
        articles.groupBy("state_updated_at", "processing_state")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin", F.floor(F.unix_seconds("state_updated_at") / width))
    )
    own = F.floor(F.unix_seconds("ran_at") / width)
    spans = runs.select("analysis_run_id", "ran_at", F.explode(F.array(own, own + 1)).alias("bin"))
    end = F.col("ran_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return (
        moves.join(spans, "bin")
        .where((F.col("state_updated_at") >= F.col("ran_at")) & (F.col("state_updated_at") <= end))
        .groupBy("analysis_run_id", "processing_state")
        .agg(F.sum("n").alias("n"))
    )


def outlet_article_counts(outlets: DataFrame, articles: DataFrame) -> DataFrame:
    """Every outlet with its number of articles, also 0."""
    counts = articles.groupBy("outlet_id").agg(F.count(F.lit(1)).alias("n"))
    return outlets.join(counts, "outlet_id", "left").select(
        "outlet_id", "slug", "name", "active", F.coalesce("n", F.lit(0).cast("long")).alias("article_count")
    ).orderBy("outlet_id")


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The last runs with their length in whole seconds, null while open."""
    seconds = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1e6
    return runs.orderBy(F.desc("run_id")).limit(n).withColumn("seconds", F.round(seconds).cast("long"))


def top_stories(stories: DataFrame, articles: DataFrame, outlets: DataFrame, n: int = 20) -> DataFrame:
    """The largest stories with their outlets as a comma list; ``n`` lies in 1..1000."""
    bounded("n", n, 1000)
    top = stories.orderBy(F.desc("article_count"), "story_id").limit(n).select("story_id", "title", "article_count", "first_seen_at", "last_seen_at")
    covering = (
        articles.join(F.broadcast(top.select("story_id")), "story_id", "left_semi")  # n rows
        .select("story_id", "outlet_id").distinct()
        .join(outlets.select("outlet_id", "slug"), "outlet_id")
        .groupBy("story_id").agg(F.array_join(F.array_sort(F.collect_set("slug")), ",").alias("outlets"))
    )
    return top.join(covering, "story_id", "left")


def story_stats(stories: DataFrame) -> DataFrame:
    return stories.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("article_count") > 1).alias("multi_article")
    )


def recent_articles(articles: DataFrame, outlets: DataFrame, n: int = 5, headline_chars: int = 60) -> DataFrame:
    """The ``n`` latest articles with the first ``headline_chars`` characters of their headline."""
    return (
        articles.orderBy(F.desc("article_id")).limit(n)
        .select("article_id", "outlet_id", "processing_state", "attempt_count", F.substring("headline", 1, headline_chars).alias("headline"), "story_id")
        .join(outlets.select("outlet_id", "slug"), "outlet_id")
        .drop("outlet_id")
    )


def failed_articles(articles: DataFrame, outlets: DataFrame, n: int = 10, error_chars: int = 200) -> DataFrame:
    """The ``n`` latest failed articles with the first ``error_chars`` characters of their error."""
    return (
        articles.where(F.col("processing_state").isin("failed_extract", "failed_embed", "failed_analyze"))
        .orderBy(F.desc("article_id")).limit(n)
        .select("article_id", "outlet_id", "processing_state", "attempt_count", F.substring("state_error", 1, error_chars).alias("error"), "url")
        .join(outlets.select("outlet_id", "slug"), "outlet_id")
        .drop("outlet_id")
    )


def completeness(articles: DataFrame, embedded_ids: DataFrame) -> DataFrame:
    """Articles with search terms and with an embedding, in number and whole per cent."""
    flagged = articles.select("article_id", (F.length(F.concat_ws(" ", "headline", "full_text")) > 0).alias("has_terms")).join(
        embedded_ids.select("article_id", F.lit(True).alias("has_embedding")), "article_id", "left"
    )
    counts = flagged.agg(
        F.count_if("has_terms").alias("with_terms"),
        F.count("has_embedding").alias("with_embedding"),
        F.count(F.lit(1)).alias("total"),
    )
    base = F.greatest("total", F.lit(1))
    return counts.select(
        "*",
        F.floor(F.col("with_terms") * 100 / base).alias("terms_pct"),
        F.floor(F.col("with_embedding") * 100 / base).alias("embedding_pct"),
    )


def _marks(
    table: DataFrame, unique: dict[str, tuple[str, ...]] | None = None, refers: dict[str, tuple[str, str]] | None = None,
    broken: dict[str, Column] | None = None,
) -> DataFrame:
    """(kind, key, rule) of one pass over a table; a null key says nothing.

    ``unique``: rule -> columns of a key that the table defines (null rule).  ``refers``: rule -> (rule that defines the
    key, column).  ``broken``: rule -> predicate of a bad row.
    """

    def mark(kind: str, key: Column, rule: str | None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(rule).cast("string").alias("rule"))

    marks = [
        # A key with a null part is equal to no other.
        mark(rule, F.when(F.concat(*(F.col(c).cast("string") for c in columns)).isNotNull(), F.to_json(F.array(*(F.col(c).cast("string") for c in columns)))), None)
        for rule, columns in (unique or {}).items()
    ]
    marks += [mark(kind, F.when(F.col(c).isNotNull(), F.to_json(F.array(F.col(c).cast("string")))), rule) for rule, (kind, c) in (refers or {}).items()]
    marks += [mark("", F.when(bad, ""), rule) for rule, bad in (broken or {}).items()]
    return table.select(F.explode(F.filter(F.array(*marks), lambda m: m["key"].isNotNull())).alias("m")).select("m.*")


def constraint_violations(
    articles: DataFrame, outlets: DataFrame, stories: DataFrame, analysis: DataFrame,
    comparisons: DataFrame, ratings: DataFrame, runs: DataFrame, analysis_runs: DataFrame,
) -> DataFrame:
    """Violations per rule: unique keys, orphan references, value ranges and allowed values.

    Each table is read once.  Its rows give the keys they define, those they refer to and the rules they break; one
    aggregate per key, summed before the shuffle, then tells keys defined twice and references to none.
    """

    def outside(name: str, low: float) -> Column:
        return ~F.col(name).between(low, 1)

    tables = [
        (articles, {"articles_unique_id": ("article_id",), "articles_unique_url": ("url",)},
         {"articles_outlet": ("outlets_unique_id", "outlet_id"), "articles_story": ("stories_unique_id", "story_id")},
         {"articles_state": ~F.col("processing_state").isin(*C.PROCESSING_STATES)}),
        (outlets, {"outlets_unique_id": ("outlet_id",), "outlets_unique_slug": ("slug",)}, {}, {}),
        (stories, {"stories_unique_id": ("story_id",)}, {}, {}),
        (analysis, {"analysis_unique_article": ("article_id",)},
         {"analysis_article": ("articles_unique_id", "article_id"), "analysis_run": ("analysis_runs_unique_id", "analysis_run_id")},
         {
             "analysis_framing_score": outside("framing_score", -1),
             "analysis_framing_confidence": outside("framing_confidence", 0),
             "analysis_headline_sentiment": outside("headline_sentiment", -1),
             "analysis_body_sentiment": outside("body_sentiment", -1),
             "analysis_framing_label": ~F.col("framing_label").isin(*C.FRAMING_LABELS),
         }),
        (comparisons, {"comparisons_unique_story": ("story_id",)}, {"comparisons_story": ("stories_unique_id", "story_id")}, {}),
        (ratings, {"ratings_unique_outlet_source": ("outlet_id", "source")}, {"ratings_outlet": ("outlets_unique_id", "outlet_id")},
         {"ratings_category": ~F.col("normalized_category").isin(*C.BIAS_CATEGORIES)}),
        (runs, {"runs_unique_id": ("run_id",)}, {},
         {"runs_triggered_by": ~F.col("triggered_by").isin(*C.RUN_TRIGGERS), "runs_status": ~F.col("status").isin(*C.RUN_STATUSES)}),
        (analysis_runs, {"analysis_runs_unique_id": ("analysis_run_id",)}, {},
         {"analysis_runs_purpose": ~F.col("purpose").isin(*C.RUN_PURPOSES)}),
    ]
    marks = reduce(DataFrame.unionByName, (_marks(*table) for table in tables))
    unique, refers, broken = ([rule for table in tables for rule in table[k]] for k in (1, 2, 3))
    per_key = marks.groupBy("kind", "key").agg(
        F.count_if(F.col("rule").isNull()).alias("defined"), *(F.count_if(F.col("rule") == rule).alias(rule) for rule in refers + broken)
    )
    zero = F.lit(0).cast("long")
    counts = per_key.agg(
        *(F.count_if((F.col("kind") == rule) & (F.col("defined") > 1)).alias(rule) for rule in unique),
        *(F.coalesce(F.sum(F.when(F.col("defined") == 0, F.col(rule))), zero).alias(rule) for rule in refers),
        *(F.coalesce(F.sum(rule), zero).alias(rule) for rule in broken),
    )
    found = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in unique + refers + broken))
    return counts.select(F.inline(found))
