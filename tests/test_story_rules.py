"""Boundary values of the story rules on hand-made frames."""

import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pressgrid.operators import dashboards, filters, quality, selection, state, stories

NOW = datetime(2026, 9, 27, 12, tzinfo=timezone.utc)


def as_of():
    return F.lit(NOW)


def hours(n):
    return NOW - timedelta(hours=n)


AGG = "story_id long, last_seen_at timestamp, distinct_outlets long, analyzed_articles long, positive_articles long, mean_body_sentiment double"


def test_positive_story_reasons_at_the_boundaries(spark):
    rows = [
        (1, hours(7 * 24), 3, 5, 3, 0.15),       # all bars exactly met
        (2, NOW - timedelta(days=7, seconds=1), 9, 9, 9, 0.9),
        (3, hours(1), 2, 9, 9, 0.9),
        (4, hours(1), 3, 2, 2, 0.9),
        (5, hours(1), 3, 5, 5, None),
        (6, hours(1), 3, 5, 5, 0.1499),
        (7, hours(1), 3, 5, 2, 0.5),             # one very positive outlier is not enough
    ]
    got = {r.story_id: r.reason for r in stories.positive_story_reasons(spark.createDataFrame(rows, AGG), as_of()).collect()}
    assert got == {1: None, 2: "stale", 3: "too_few_outlets", 4: "too_few_analyzed", 5: "too_few_analyzed", 6: "mean_too_low", 7: "consensus_too_low"}


def test_freshness_boundary_is_inclusive(spark):
    df = spark.createDataFrame([(1, hours(72)), (2, NOW - timedelta(hours=72, seconds=1))], "story_id long, last_seen_at timestamp")
    assert [r.story_id for r in stories.fresh_stories(df, as_of()).collect()] == [1]


OUTLETS = "outlet_id long, slug string, name string, website string, active boolean"


def outlets(spark, n=6):
    return spark.createDataFrame([(i, f"o{i}", f"Outlet {i}", f"w{i}", True) for i in range(1, n + 1)], OUTLETS)


def test_bias_distribution_rules(spark):
    arts = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 4), (3, 5), (3, 6)], "story_id long, outlet_id long")
    ratings = spark.createDataFrame(
        [(1, "MBFC", "Left-Center", "right"), (1, "Other", "Right", "right"), (2, "MBFC", "least biased ", None), (3, "MBFC", "Curious", "right"),
         (4, "MBFC", "Curious", None), (5, "Other", "Left", "left")],
        "outlet_id long, source string, original_label string, normalized_category string",
    ).selectExpr("*", "'' as rating_url", "cast(null as timestamp) as rated_at")
    got = {r.story_id: r for r in stories.bias_distribution(arts, outlets(spark), ratings).collect()}
    one = got[1]  # outlet 1 counts once, its label beats the stored category; outlet 3 falls back; outlet 4 is unrated
    assert (one.eligible, one.left_count, one.center_count, one.right_count) == (True, 1, 1, 1)
    assert (one.left_pct, one.unrated_slugs, one.total_outlet_count) == (33.33, ["o4"], 4)
    assert (got[2].reason, got[2].rated_outlet_count, got[2].unrated_slugs) == ("too_few_outlets", 0, ["o1", "o2"])
    assert (got[3].reason, got[3].unrated_outlet_count, got[3].left_pct) == ("too_few_rated_outlets", 3, 0.0)


def images_model(rows, count):
    """Turn-taking written as a plain loop over what is left of each outlet's queue."""
    limit = 0 if count < 2 else 1 if count <= 6 else 2 if count <= 10 else 3
    queues = {}
    for outlet, article, url, at in rows:
        if url and url.strip():
            queues.setdefault(f"o{outlet}", []).append((-at, article, url))
    for q in queues.values():
        q.sort()
    order = sorted(queues, key=lambda slug: (queues[slug][0][0], slug))
    chosen, turn = [], 0
    while len(chosen) < limit:
        fresh = 0
        for slug in order:
            if turn < len(queues[slug]) and len(chosen) < limit and queues[slug][turn][2] not in [c[1] for c in chosen]:
                chosen.append((queues[slug][turn][1], queues[slug][turn][2]))
                fresh += 1
        if not fresh:
            break
        turn += 1
    return chosen


def test_story_images_match_turn_taking(spark):
    rng = random.Random(5)
    rows, counts, expected = [], [], {}
    article = 0
    for story in range(120):
        mine = []
        for _ in range(rng.randrange(0, 9)):
            article += 1
            mine.append((rng.randrange(1, 5), article, rng.choice([None, " ", "u1", "u2", "u3", "u4"]), rng.randrange(0, 6)))
        count = rng.choice([1, 2, 6, 7, 10, 11])
        rows += [(story, o, a, u, NOW + timedelta(hours=t)) for o, a, u, t in mine]
        counts.append((story, count))
        expected[story] = images_model(mine, count)
    arts = spark.createDataFrame(rows, "story_id long, outlet_id long, article_id long, image_url string, published_at timestamp")
    got = stories.story_images(arts, outlets(spark), spark.createDataFrame(counts, "story_id long, article_count long")).orderBy("story_id", "rank_no").collect()
    found = {s: [] for s in expected}
    for r in got:
        found[r.story_id].append((r.article_id, r.url))
    assert found == expected


def analysis_frame(spark, rows):
    return spark.createDataFrame(rows, "article_id long, framing_score decimal(3,2), framing_confidence decimal(3,2), body_sentiment decimal(3,2), key_themes array<string>")


def test_framing_spread_and_buckets(spark):
    arts = spark.createDataFrame(
        [(1, 1, 1, "analyzed"), (2, 1, 2, "complete"), (3, 1, 3, "complete"), (4, 2, 1, "analyzed"), (5, 3, 1, "clustered"), (6, 3, 2, "clustered")],
        "article_id long, story_id long, outlet_id long, processing_state string")
    d = Decimal
    an = analysis_frame(spark, [(1, d("-0.60"), None, None, []), (2, d("0.00"), None, None, []), (3, d("0.60"), None, None, []),
                                (4, d("0.15"), None, None, []), (5, d("-0.15"), None, None, []), (6, None, None, None, [])])
    spread = {r.story_id: r.framing_spread for r in stories.framing_spread(arts, an).collect()}
    assert spread == {1: 0.49, 2: 0.0}
    loose = {r.story_id: r.spread for r in stories.framing_spread_nullable(arts, an).collect()}
    assert loose[2] is None and loose[3] is None and abs(loose[1] - 0.4898979) < 1e-6
    buckets = {(r.story_id, r.slug): r.bucket for r in stories.framing_by_outlet(arts, outlets(spark), an).collect()}
    assert buckets[(2, "o1")] == "supportive" and buckets[(3, "o1")] == "critical" and buckets[(1, "o2")] == "neutral" and buckets[(3, "o2")] is None


def test_theme_counts_and_first_seen_order(spark):
    arts = spark.createDataFrame([(i, 1, 1, hours(1), "complete") for i in (1, 2, 3)], "article_id long, story_id long, outlet_id long, published_at timestamp, processing_state string")
    an = analysis_frame(spark, [(1, None, None, None, ["economy", "budget", " tax"]), (2, None, None, None, ["budget", "tax", "deficit"]), (3, None, None, None, ["budget", "deficit", " "])])
    union = stories.theme_union(arts, an).orderBy("first_article", "first_pos").collect()
    assert [r.theme for r in union] == ["economy", "budget", "tax", "deficit"]
    counts = {r.theme: r.n for r in dashboards.outlet_theme_counts(arts, an, as_of()).collect()}
    assert counts["budget"] == 3 and counts["deficit"] == 2 and counts["economy"] == 1


ARTICLE = "article_id long, processing_state string, state_updated_at timestamp, state_error string, attempt_count long"


def test_three_strikes_and_rate_limits(spark):
    arts = spark.createDataFrame([(1, "discovered", hours(9), "e", 2), (2, "clustered", hours(9), None, 2), (3, "clustered", hours(9), None, 1),
                                  (4, "clustered", hours(9), None, 2), (5, "extracted", hours(9), "keep", 1)], ARTICLE)
    outcomes = spark.createDataFrame(
        [(1, True, None, None, None, None), (2, False, "x" * 3000, "ApiError", 500, None), (3, False, "e3", "ApiError", 500, None), (4, False, "slow", "ApiError", 429, None)],
        "article_id long, ok boolean, error string, error_name string, error_code int, error_status string")
    got = {r.article_id: (r.processing_state, r.attempt_count, r.state_error) for r in state.apply_llm_outcomes(arts, outcomes, as_of()).collect()}
    assert got == {1: ("extracted", 0, None), 2: ("failed_analyze", 3, "x" * 2000), 3: ("clustered", 2, "e3"), 4: ("clustered", 2, "slow"), 5: ("extracted", 1, "keep")}
    plain = {r.article_id: r.processing_state for r in state.apply_outcomes(arts, outcomes, as_of()).collect()}
    assert plain[4] == "failed_analyze"


def test_compare_gate(spark):
    arts = spark.createDataFrame(
        [(1, 1, 1, "analyzed", hours(1)), (2, 1, 2, "complete", hours(9)), (3, 2, 1, "complete", hours(1)), (4, 2, 2, "complete", hours(1)),
         (5, 3, 1, "analyzed", hours(1)), (6, 3, 1, "analyzed", hours(1)), (7, 4, 1, "complete", hours(1)), (8, 4, 2, "complete", hours(1))],
        "article_id long, story_id long, outlet_id long, processing_state string, state_updated_at timestamp")
    done = spark.createDataFrame([(1, hours(5)), (2, hours(5))], "story_id long, generated_at timestamp")
    # 1: fresh analysis after the comparison; 2: nothing new; 3: one outlet; 4: never compared
    assert [r.story_id for r in selection.compare_candidates(arts, done).collect()] == [1, 4]


def test_enrich_cap_and_home_tier(spark):
    rows = []
    for i in range(30):  # a hot story: 30 waiting articles of 3 outlets
        rows.append((i, 1, 1 + i % 3, hours(100 + i)))
    rows += [(100, 2, 1, hours(1)), (101, 2, 2, hours(2)), (200, 3, 1, hours(1))]
    arts = spark.createDataFrame(rows, "article_id long, story_id long, outlet_id long, published_at timestamp").selectExpr("*", "'clustered' as processing_state", "0L as attempt_count")
    st = spark.createDataFrame([(1, hours(100)), (2, hours(1)), (3, hours(1))], "story_id long, last_seen_at timestamp")
    none = spark.createDataFrame([], "story_id long")
    got = selection.enrich_candidates(arts, outlets(spark), st, none, as_of()).collect()
    assert sorted(r.article_id for r in got) == [0, 1, 2, 3, 100, 101]   # single-outlet story 3 never enters
    assert {r.article_id: r.tier for r in got} == {0: 2, 1: 2, 2: 2, 3: 2, 100: 0, 101: 0}


def test_diverse_sample_matches_greedy_picking(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.randrange(1, 6), NOW - timedelta(minutes=rng.randrange(5000) * 7 + i)) for i in range(1, 150)]
    arts = spark.createDataFrame(rows, "article_id long, story_id long, outlet_id long, published_at timestamp").selectExpr("*", "'clustered' as processing_state", "'t' as full_text")
    got = [r.article_id for r in selection.diverse_sample(arts, outlets(spark)).orderBy("pick_no").collect()]
    sizes = {}
    for a, s, o, _ in rows:
        if s:
            sizes.setdefault(s, []).append(o)
    big = sorted((s for s in sizes if len(set(sizes[s])) >= 2), key=lambda s: (-len(set(sizes[s])), -len(sizes[s]), -s))[:4]
    picks, load = [], {}
    for s in big:
        for o in sorted(set(sizes[s]))[:3]:
            best = max((r for r in rows if r[1] == s and r[2] == o), key=lambda r: (r[3], -r[0]))
            picks.append(best[0])
            load[o] = load.get(o, 0) + 1
    rest = sorted((r for r in rows if r[0] not in picks), key=lambda r: (r[3], r[0]), reverse=True)[:200]
    while len(picks) < 20 and rest:
        r = min(rest, key=lambda r: (load.get(r[2], 0), -r[0]))
        rest.remove(r)
        picks.append(r[0])
        load[r[2]] = load.get(r[2], 0) + 1
    assert got == picks


def test_touched_window_is_closed_at_both_ends(spark):
    arts = spark.createDataFrame([(hours(2), "a"), (hours(2) + timedelta(minutes=30), "a"), (hours(2) + timedelta(minutes=30, seconds=1), "a"), (hours(2) - timedelta(seconds=1), "a")],
                                 "state_updated_at timestamp, processing_state string")
    runs = spark.createDataFrame([(1, hours(2))], "analysis_run_id long, ran_at timestamp")
    assert quality.run_touched_articles(arts, runs).collect()[0].n == 2


def test_source_distribution_folds_keys(spark):
    arts = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 2)], "article_id long, story_id long, outlet_id long")
    an = spark.createDataFrame([(1, {"Civil Society": 2.0, "blog": 1.4, "expert": -3.0}), (2, {" GOVERNMENT ": 0.5})], "article_id long, source_distribution map<string,double>")
    got = {r.slug: r for r in stories.source_distribution(arts, outlets(spark), an).collect()}
    assert (got["o1"].civil_society, got["o1"].other, got["o1"].expert, got["o1"].government, got["o1"].total) == (2, 1, 0, 1, 4)
    assert got["o2"].total == 0


@pytest.mark.parametrize("matrix, expected", [
    ('{" o1 ":{"b":0.4,"a":"0.9","c":7,"d":null}}', [("c", 1.0), ("a", 0.9), ("b", 0.4), ("d", None)]),
    ('{"o1":["x"," y ",5,""]}', [("x", None), ("y", None)]),
    ('{"o1":{"themes":["x"]}}', [("x", None)]),
    ('{"o1":"solo"}', [("solo", None)]),
    ('{"o1":12}', [(None, None)]),
])
def test_emphasis_tolerates_every_shape(spark, matrix, expected):
    comparisons = spark.createDataFrame([(1, matrix)], "story_id long, coverage_matrix string")
    arts = spark.createDataFrame([(1, 1, 1)], "article_id long, story_id long, outlet_id long")
    got = stories.outlet_emphasis(comparisons, arts, outlets(spark)).orderBy("theme_no").collect()
    assert [(r.theme, r.weight) for r in got] == expected and got[0].name == "Outlet 1"


def test_gaps_read_ragged_cells(spark):
    text = '{"new_key":[" a ",{"k":1},2,null,""],"o1":{"missing-part":"x","n":3},"o2":"one","o3":null}'
    comparisons = spark.createDataFrame([(1, text)], "story_id long, not_present_here string")
    arts = spark.createDataFrame([(1, 1, 1)], "article_id long, story_id long, outlet_id long")
    got = {}
    for r in stories.coverage_gaps(comparisons, arts, outlets(spark)).orderBy("pos").collect():
        got.setdefault((r.slug, r.name), []).append(r.item)
    assert got == {("new_key", "New Key"): ["a", '{"k":1}', "2", "null"], ("o1", "Outlet 1"): ["Missing Part: x", "N: 3"], ("o2", "O2"): ["one"]}


ANALYSIS = """article_id long, framing_score decimal(3,2), framing_label string, framing_confidence decimal(3,2), headline_sentiment decimal(3,2),
body_sentiment decimal(3,2), entities struct<people:array<string>>, source_distribution map<string,double>, analyzed_at timestamp,
key_themes array<string>, quoted_sources array<struct<speaker:string,quote:string>>, evidence_snippets array<string>"""


def detail_frames(spark):
    """Two stories: one with two analysed outlets, an image and a comparison, one with a single bare article."""
    articles = spark.createDataFrame(
        [(1, 1, 7, "u1", "first", None, hours(4), "https://i/1.jpg", "complete", "body"),
         (2, 2, 7, "u2", "second", "ann", hours(3), None, "complete", ""),
         (3, 2, 8, "u3", "alone", None, hours(2), None, "discovered", None),
         (4, 1, None, "u4", "no story", None, hours(1), None, "discovered", None)],
        "article_id long, outlet_id long, story_id long, url string, headline string, author string, published_at timestamp, image_url string, "
        "processing_state string, full_text string",
    )
    analysis = spark.createDataFrame(
        [(1, Decimal("-0.40"), "critical", Decimal("0.90"), Decimal("0.10"), Decimal("0.20"), (["Ann"],), {"expert": 1.0}, hours(1),
          ["budget"], [("Ann", "so it is")], ["words"]),
         (2, None, None, None, None, None, None, None, hours(1), None, None, None)],
        ANALYSIS,
    )
    heads = spark.createDataFrame(
        [(7, "first", "economy", hours(4), hours(3), 2, None), (8, "alone", None, hours(2), hours(2), 1, None)],
        "story_id long, title string, topic string, first_seen_at timestamp, last_seen_at timestamp, article_count long, summary string",
    )
    compared = spark.createDataFrame(
        [(7, "- they differ", Decimal("0.35"), '{"s1":{"budget":1.0}}', "{}", hours(1))],
        "story_id long, differences string, framing_spread decimal(3,2), coverage_matrix string, not_present_here string, generated_at timestamp",
    )
    return articles, analysis, heads, compared


def test_details_hold_the_whole_analysis(spark):
    articles, analysis, heads, compared = detail_frames(spark)
    rows = {r.article_id: r for r in filters.article_detail(articles, outlets(spark), analysis).collect()}
    assert rows[1].full_text_available and not rows[2].full_text_available and not rows[3].full_text_available
    assert rows[1].entities.people == ["Ann"] and rows[1].source_distribution == {"expert": 1.0} and rows[1].quoted_sources[0].quote == "so it is"
    # An analysis without lists has empty ones; an article without analysis has none at all.
    assert (rows[2].key_themes, rows[2].quoted_sources, rows[2].evidence_snippets) == ([], [], []) and rows[2].analyzed_at is not None
    assert rows[3].key_themes is None and rows[3].analyzed_at is None
    assert [r.article_id for r in filters.article_detail(articles, outlets(spark), analysis, article_id=2).collect()] == [2]
    page = stories.story_detail(heads, articles, outlets(spark), analysis, compared, story_id=7).orderBy("published_at", "article_id").collect()
    assert [(r.article_id, r.evidence_snippets, r.differences) for r in page] == [(1, ["words"], "- they differ"), (2, [], "- they differ")]


def test_story_header(spark):
    articles, _, heads, compared = detail_frames(spark)
    ratings = spark.createDataFrame([], "outlet_id long, source string, original_label string, normalized_category string, rating_url string, rated_at timestamp")
    rows = {r.story_id: r for r in stories.story_header(heads, articles, outlets(spark), compared, ratings).collect()}
    assert rows[7].hero_image_url == "https://i/1.jpg" and [x.article_id for x in rows[7].story_images] == [1]
    assert rows[7].coverage_matrix == '{"s1":{"budget":1.0}}' and rows[7].generated_at is not None and rows[7].outlet_count == 2
    assert (rows[7].eligible, rows[7].reason, rows[7].bias_sources) == (False, "too_few_outlets", [])
    assert (rows[8].differences, rows[8].story_images, rows[8].hero_image_url, rows[8].outlet_count) == (None, [], None, 1)
    assert [r.story_id for r in stories.story_header(heads, articles, outlets(spark), compared, ratings, story_id=8).collect()] == [8]


def test_ledger_rows(spark):
    articles = spark.createDataFrame([(1, "discovered", 0), (2, "clustered", 2)], "article_id long, processing_state string, attempt_count long")
    outcome = "article_id long, ok boolean"
    runs = spark.createDataFrame([(4,), (7,)], "run_id long")
    offered = spark.createDataFrame([(True,), (False,), (None,)], "inserted boolean")

    def row(outcomes, runs=runs, **more):
        return state.run_ledger_row(articles, spark.createDataFrame(outcomes, outcome), runs, offered, F.lit(hours(1)), as_of(), **more).first()

    done = row([(1, True), (2, False)])
    assert (done.run_id, done.triggered_by, done.articles_discovered, done.articles_inserted) == (8, "cron", 3, 1)
    assert (done.articles_extracted, done.articles_failed, done.llm_calls, done.status, done.error) == (1, 1, 1, "success", None)
    assert row([]).status == "skipped" and row([(2, False)]).status == "failed"
    broken = row([(1, True)], error="x" * 5000, error_chars=10, triggered_by="manual")
    assert (broken.status, broken.error, broken.triggered_by) == ("failed", "x" * 10, "manual")
    assert row([], runs=runs.where("run_id > 9")).run_id == 1
    opened = state.open_run(runs, as_of(), "backfill").first()
    assert (opened.run_id, opened.status, opened.completed_at, opened.articles_inserted) == (8, "running", None, 0)
    with pytest.raises(ValueError):
        state.open_run(runs, as_of(), "hand")
