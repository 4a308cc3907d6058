"""Each rule of the constraint audit on rows that break it."""

from pressgrid.operators import quality

SCHEMAS = {
    "articles": "article_id long, outlet_id long, story_id long, url string, processing_state string",
    "outlets": "outlet_id long, slug string",
    "stories": "story_id long",
    "analysis": "article_id long, analysis_run_id long, framing_score double, framing_confidence double, headline_sentiment double, body_sentiment double, framing_label string",
    "comparisons": "story_id long",
    "ratings": "outlet_id long, source string, normalized_category string",
    "runs": "run_id long, triggered_by string, status string",
    "analysis_runs": "analysis_run_id long, purpose string",
}
GOOD = {
    "articles": [(1, 1, 5, "u1", "complete"), (2, 1, None, None, "discovered"), (3, 1, None, None, None)],
    "outlets": [(1, "s1"), (2, "s2")],
    "stories": [(5,)],
    "analysis": [(1, 9, -1.0, 0.0, 1.0, None, None)],
    "comparisons": [(5,)],
    "ratings": [(1, "MBFC", "left"), (1, "AdFontes", None), (None, "MBFC", "left"), (None, "MBFC", "left")],
    "runs": [(1, "cron", "running")],
    "analysis_runs": [(9, "enrich")],
}


def violations(spark, **more):
    frames = {name: spark.createDataFrame(GOOD[name] + more.get(name, []), schema) for name, schema in SCHEMAS.items()}
    return {r.rule: r.violations for r in quality.constraint_violations(**frames).collect() if r.violations}


def test_good_and_empty_tables_break_nothing(spark):
    assert violations(spark) == {}
    empty = {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
    assert {r.violations for r in quality.constraint_violations(**empty).collect()} == {0}


def test_every_rule(spark):
    found = violations(
        spark,
        articles=[(1, 7, 6, "u1", "lost"), (4, 7, 6, "u4", "complete")],
        outlets=[(2, "s1")],
        stories=[(5,), (5,)],
        analysis=[(1, 8, -1.01, -0.1, 1.5, 2.0, "left"), (70, 9, None, 1.1, None, None, "mixed")],
        comparisons=[(5,), (77,)],
        ratings=[(1, "MBFC", "far"), (33, "MBFC", "left")],
        runs=[(1, "hand", "open")],
        analysis_runs=[(9, "audit")],
    )
    assert found == {
        "articles_unique_id": 1, "articles_unique_url": 1, "outlets_unique_id": 1, "outlets_unique_slug": 1, "stories_unique_id": 1,
        "analysis_unique_article": 1, "comparisons_unique_story": 1, "ratings_unique_outlet_source": 1, "runs_unique_id": 1,
        "analysis_runs_unique_id": 1, "articles_outlet": 2, "articles_story": 2, "analysis_article": 1, "analysis_run": 1,
        "comparisons_story": 1, "ratings_outlet": 1, "articles_state": 1, "analysis_framing_score": 1, "analysis_framing_confidence": 2,
        "analysis_headline_sentiment": 1, "analysis_body_sentiment": 1, "analysis_framing_label": 1, "ratings_category": 1,
        "runs_triggered_by": 1, "runs_status": 1, "analysis_runs_purpose": 1,
    }


def test_each_table_is_read_once(spark, tmp_path, capsys):
    frames = {}
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(GOOD[name], schema).write.parquet(str(tmp_path / name))
        frames[name] = spark.read.schema(schema).parquet(str(tmp_path / name))
    capsys.readouterr()
    quality.constraint_violations(**frames).explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == len(SCHEMAS) and "Join" not in plan
