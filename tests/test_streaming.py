"""Streams over several micro-batches."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F, types as T

from pressgrid.session import subfolders
from pressgrid.streaming import jobs, steps
from pressgrid.streaming.tables import DayTable, KeyedTable, ResultTable
from test_clustering import NOW, SCHEMA, case, one_by_one

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def batches(spark, folder, rows_of_batches, schema, run):
    """Each list of rows arrives as one file, and the stream is started anew after it."""
    for k, rows in enumerate(rows_of_batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
        run(spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{folder}/in/*"))


def shape(ddl):
    return T.StructType.fromDDL(ddl)


def test_discovery_keeps_the_first_over_batches(spark, folder):
    out = ResultTable(spark, f"{folder}/out", shape("url string, headline string, processing_state string, attempt_count long"))
    known = spark.createDataFrame([("old",), ("old",)], "url string")
    day = lambda d: T0 + timedelta(days=d)
    rows = [
        [("a", "a1", 1, day(0)), ("a", "a0", 0, day(0)), ("old", "o", 2, day(0))],
        [("a", "a2", 2, day(2)), ("b", "b1", 3, day(3))],
        [("old", "o2", 9, day(4)), ("b", "b0", 0, day(4)), ("c", "c", 4, day(40))],
        [("d", "d", 5, day(41))],
        [("a", "again", 6, day(41)), ("c", "c2", 7, day(42))],
    ]
    schema = "url string, headline string, arrival long, fetched_at timestamp"
    batches(spark, folder, rows, schema, lambda s: steps.stream_discover(s, f"{folder}/cp", out, known, days=5))
    got = {(r.url, r.headline) for r in out.read(spark).collect()}
    assert got == {("a", "a0"), ("b", "b1"), ("c", "c"), ("d", "d"), ("a", "again")}  # after 40 days a is forgotten


def test_daily_counts_over_batches(spark, folder):
    day = lambda d, h: (T0 + timedelta(days=d, hours=h),)
    out = KeyedTable(spark, f"{folder}/out", shape("date string, n long"), "date", buckets=3)
    rows = [[day(0, 1), day(1, 2)], [day(1, 3), day(2, 0)], [day(9, 0)], [day(9, 1)], [day(0, 5)]]
    batches(spark, folder, rows, "ts timestamp", lambda s: steps.stream_daily_counts(s, f"{folder}/cp", out, "3 days"))
    got = {r.date: r.n for r in out.read(spark).collect()}
    assert got == {"2024-01-01": 1, "2024-01-02": 2, "2024-01-03": 1, "2024-01-10": 2}  # the last row came too late


def test_attempts_over_batches(spark, folder):
    def row(article, minute, ok):
        return (article, T0 + timedelta(minutes=minute), minute, ok)

    rows = [
        [row(1, 2, False), row(1, 1, False), row(2, 3, False), *(row(4, k, True) for k in range(3)), *(row(5, k, False) for k in range(500))],
        [row(1, 4, False), row(2, 6, True), row(2, 5, False), row(3, 6, False), row(4, 7, True)],
        [row(1, 7, True), row(2, 8, False), row(3, 9, False), *(row(4, 10 + k, False) for k in range(3))],
    ]
    out = KeyedTable(spark, f"{folder}/out", shape("article_id long, processing_state string, attempts long"), "article_id", buckets=2)
    batches(spark, folder, rows, "article_id long, at timestamp, seq long, ok boolean", lambda s: steps.stream_attempts(s, f"{folder}/cp", out))
    got = {r.article_id: (r.processing_state, r.attempts) for r in out.read(spark).collect()}
    # 2 failed twice, advanced and failed once at its new stage; 4 passed all stages
    assert got == {1: ("failed_extract", 3), 2: ("extracted", 1), 3: ("discovered", 2), 4: ("analyzed", 0), 5: ("failed_extract", 3)}


def test_many_articles_advance_together(spark, folder, capsys):
    """All articles of a batch, also rows without an article; no Python call goes article by article."""
    rows = [[(k % 97 or None, T0 + timedelta(minutes=k), k, k % 97 % 2 == 0) for k in range(b * 200, b * 200 + 200)] for b in range(2)]
    out = KeyedTable(spark, f"{folder}/out", shape("article_id long, processing_state string, attempts long"), "article_id", buckets=2)

    schema = "article_id long, at timestamp, seq long, ok boolean"
    batches(spark, folder, rows, schema, lambda s: steps.stream_attempts(s, f"{folder}/cp", out))
    steps.keyed.advanced(out.read(spark), spark.createDataFrame(rows[0], schema)).explain()
    plan = capsys.readouterr().out
    assert "FlatMapGroups" not in plan and "TransformWithState" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    got = {r.article_id: (r.processing_state, r.attempts) for r in out.read(spark).collect()}
    # 400 rows: four for each article, five for a few; odd ones fail, the rows without an article succeed
    assert got == {a or None: ("failed_extract", 3) if a % 2 else ("analyzed", 0) for a in range(97)}
    assert out.read(spark).count() == 97


def test_clusters_over_batches(spark, folder):
    rows = sorted(((a, at, v, None) for a, at, v, _ in case(11, n=24)), key=lambda r: (r[1], r[0]))
    stored = T.StructType([f for f in spark.createDataFrame([], SCHEMA).schema])
    store, out = DayTable(spark, f"{folder}/store", stored), ResultTable(spark, f"{folder}/out", shape("article_id long, story_id long"))
    run = lambda s: steps.stream_cluster(s, f"{folder}/cp", store, out, F.lit(NOW), lookback_days=3, threshold=0.75)
    batches(spark, folder, [rows[:8], rows[8:16], rows[16:]], SCHEMA, run)
    expected = {a: s for a, (s, _, _) in one_by_one(rows, 3, 0.75).items()}
    assert {r.article_id: r.story_id for r in out.read(spark).collect()} == expected
    days = [d for d in subfolders(spark, store.path) if d.startswith("day=")]
    assert days and min(days) >= "day=2024-01-28"  # nothing older than the window is stored


def test_old_days_are_not_read_and_go(spark, folder, capsys):
    store = DayTable(spark, f"{folder}/store", shape("article_id long, published_at timestamp"))
    rows = spark.createDataFrame([(k, T0 + timedelta(days=k)) for k in range(6)], "article_id long, published_at timestamp")
    for batch in (0, 0, 1):  # a repeated batch changes nothing
        store.append(rows.where(f"article_id % 2 = {batch}"), F.to_date("published_at"), batch)
    recent = store.since(spark, F.lit("2024-01-04").cast("date"), 2)
    assert {r.article_id for r in recent.collect()} == {3, 4, 5}
    assert {r.article_id for r in store.since(spark, F.lit("2024-01-01").cast("date"), 1).collect()} == {0, 2, 4}
    recent.explain()
    assert "PartitionFilters: [isnotnull(day" in capsys.readouterr().out
    store.drop_before(spark, "2024-01-04")
    assert sorted(d for d in subfolders(spark, store.path) if d.startswith("day=")) == [f"day=2024-01-0{k}" for k in (4, 5, 6)]


def test_upsert_touches_its_buckets_only_and_can_be_repeated(spark, folder):
    import os

    table = KeyedTable(spark, f"{folder}/t", shape("k long, version long, v string"), "k", buckets=16)
    latest = lambda rows: lambda i: table.upsert(
        spark.createDataFrame(rows, table.schema), i, lambda current, new: steps.upserts.latest_wins_upsert(current, new, "k", "version"))
    latest([(k, 1, "a") for k in range(40)])(0)
    before = {d: os.listdir(f"{table.path}/{d}") for d in subfolders(spark, table.path)}
    change = latest([(3, 2, "b"), (3, 0, "late"), (99, 1, "new")])
    change(1)
    after = {d: os.listdir(f"{table.path}/{d}") for d in subfolders(spark, table.path)}
    assert 1 <= sum(after[d] != before.get(d) for d in after) <= 2
    rows = {(r.k, r.version, r.v) for r in table.read(spark).collect()}
    assert rows == {(k, 1, "a") for k in range(40) if k != 3} | {(3, 2, "b"), (99, 1, "new")}
    # The batch comes again after half of its buckets were lost: its finished rows are taken again.
    os.rename(f"{table.path}/{next(d for d in after if after[d] != before.get(d))}", f"{folder}/lost")
    change(1)
    assert {(r.k, r.version, r.v) for r in table.read(spark).collect()} == rows


def test_stories_become_due_over_batches(spark, folder):
    at = lambda minute: T0 + timedelta(minutes=minute)
    rows = [
        [(1, 7, 1, "analyzed", at(1)), (2, 8, 1, "analyzed", at(1)), (3, 8, 1, "complete", at(2)), (4, 9, 1, "analyzed", at(1))],
        [(5, 7, 2, "complete", at(3)), (6, 8, 1, "analyzed", at(4)), (7, 9, 2, "analyzed", at(4)), (8, 7, 5, "discovered", at(9))],
        [(9, 9, 3, "analyzed", at(50)), (10, None, 3, "analyzed", at(60))],
    ]
    compared = spark.createDataFrame([(9, at(30))], "story_id long, generated_at timestamp")
    out = ResultTable(spark, f"{folder}/out", shape("story_id long, n_articles long, n_outlets long, latest long"))
    schema = "article_id long, story_id long, outlet_id long, processing_state string, state_updated_at timestamp"
    batches(spark, folder, rows, schema, lambda s: steps.stream_recompare(s, f"{folder}/cp", out, compared))
    got = {(r.batch, r.story_id, r.n_articles, r.n_outlets) for r in out.read(spark).collect()}
    assert got == {(1, 7, 2, 2), (2, 9, 3, 3)}  # 8 has one outlet; 9 waits for an analysis after its comparison


def test_slices_hold_every_row_once(spark, folder):
    seen = []
    jobs.arrive(spark.range(10), F.col("id"), folder, lambda s: seen.append(spark.read.parquet(f"{folder}/in/*").count()))
    assert seen[-1] == 10 and len(seen) == jobs.SLICES and 0 < seen[0] < 10
    jobs.arrive(spark.range(0), F.col("id"), f"{folder}/none", lambda s: None)
