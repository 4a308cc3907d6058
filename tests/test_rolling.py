"""Stored windows against plain recomputation, and the writers."""

import json
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from pathlib import Path

from pyspark.sql import functions as F

from pressgrid.operators import dashboards, rolling
from pressgrid.sources import sinks

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
ARTICLES = "article_id long, outlet_id long, published_at timestamp"
ANALYSIS = "article_id long, framing_score decimal(3,2), body_sentiment decimal(3,2), key_themes array<string>"


def frames(spark, n=240):
    """Some hours apart over 60 days; one outlet has a third of all, scores and themes are null at times, one has no date."""
    when = [START + timedelta(hours=6 * k) for k in range(n)]
    articles = [(k, 0 if k % 3 == 0 else k % 7, w) for k, w in enumerate(when)] + [(n, 1, None)]
    analysis = [
        (k, None if k % 5 == 0 else Decimal(k * 37 % 201 - 100) / 100, None if k % 11 == 0 else Decimal(k * 53 % 201 - 100) / 100,
         None if k % 13 == 0 else [] if k % 17 == 0 else [f"theme {k % 4}", None, f"theme {k % 4}"])
        for k in range(0, n + 1) if k % 4
    ]
    return spark.createDataFrame(articles, ARTICLES), spark.createDataFrame(analysis, ANALYSIS)


def rows(frame):
    return sorted((tuple(r) for r in frame.select("outlet_id", "article_count", "avg_framing", "avg_sentiment", "theme", "theme_count").collect()), key=repr)


def recomputed(articles, analysis, end):
    as_of = F.lit(datetime(end.year, end.month, end.day, tzinfo=timezone.utc))
    return rows(dashboards.outlet_30d_stats(articles.where(F.col("published_at") < as_of), analysis, as_of))


def test_windows_move_like_recomputation(spark, tmp_path):
    articles, analysis = frames(spark)
    stored = rolling.DailyOutletStats(spark, str(tmp_path / "days"))
    assert stored.window(date(2024, 2, 1)).count() == 0
    stored.refresh(articles, analysis)
    at, steps = date(2024, 1, 20), (1, 1, 9, 4, 45)  # the last step leaves no day in common
    window = stored.window(at)
    assert rows(rolling.window_stats(window)) == recomputed(articles, analysis, at)
    for step in steps:
        window = stored.moved(window, at, at + timedelta(days=step))
        at += timedelta(days=step)
        assert rows(rolling.window_stats(window)) == rows(rolling.window_stats(stored.window(at))) == recomputed(articles, analysis, at)


def test_refresh_replaces_whole_days(spark, tmp_path):
    articles, analysis = frames(spark, 80)
    stored = rolling.DailyOutletStats(spark, str(tmp_path / "days"))
    for _ in range(2):
        stored.refresh(articles, analysis)
    end = date(2024, 1, 31)
    assert rows(rolling.window_stats(stored.window(end))) == recomputed(articles, analysis, end)
    # A late article comes into one day, and another day loses all of its own.
    more = spark.createDataFrame([(900, 2, START + timedelta(days=3, hours=1))], ARTICLES).unionByName(articles)
    scored = spark.createDataFrame([(900, Decimal("0.50"), None, ["late"])], ANALYSIS).unionByName(analysis)
    kept = more.where(~F.col("published_at").between(F.lit(START + timedelta(days=5)), F.lit(START + timedelta(days=5, hours=23))))
    stored.refresh(kept, scored, date(2024, 1, 4), days=3)
    assert rows(rolling.window_stats(stored.window(end))) == recomputed(kept, scored, end)


def test_a_window_reads_its_days_alone(spark, tmp_path, capsys):
    stored = rolling.DailyOutletStats(spark, str(tmp_path / "days"))
    stored.refresh(*frames(spark, 80))
    capsys.readouterr()
    stored.window(date(2024, 1, 10), days=2).explain("formatted")
    assert "PartitionFilters: [isnotnull(day" in capsys.readouterr().out
    assert len(stored._between(date(2024, 1, 8), date(2024, 1, 10)).inputFiles()) > 0


def test_write_by_date_is_repeatable(spark, tmp_path):
    articles, _ = frames(spark, 12)
    path = str(tmp_path / "articles")
    for _ in range(2):
        sinks.write_by_date(articles, path, F.col("published_at"))
    assert spark.read.parquet(path).count() == 13
    sinks.write_by_date(articles.where("article_id = 0"), path, F.col("published_at"))
    left = {r.article_id for r in spark.read.parquet(path).collect()}
    assert left == {0, *range(4, 13)}  # the first day now holds one article, the others what they held


def test_report_is_one_json_file(spark, tmp_path):
    path = tmp_path / "report"
    for status in ("running", "success"):
        sinks.write_report(spark.createDataFrame([(1, status, None)], "run_id long, status string, error string"), str(path))
    (part,) = Path(path).glob("*.json")
    assert json.loads(part.read_text()) == {"run_id": 1, "status": "success", "error": None}
