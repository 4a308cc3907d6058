"""Stored index and tf-idf ranks against plain counting."""

import math
import re
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from pressgrid import constants as C
from pressgrid.operators import search

TEXTS = {
    0: ("Cities voted", "the party's policies"), 1: ("City vote", "policy party policy"), 2: ("cityvote", "policy"), 3: ("CITY, votes!", None),
    4: ("voting in cities", "x policying"), 5: ("city", "vote city vote"), 6: ("Scity votes", "policy"), 7: ("the of", "city voted"),
    8: (None, None), 70_000: ("City far away", "votes"), 140_000: ("élan vital", "policy of a city"),
}
SCHEMA = "article_id long, headline string, full_text string, url string, published_at timestamp, outlet_id long"


def articles(spark, texts=TEXTS):
    day = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return spark.createDataFrame([(i, h, b, f"u{i}", day + timedelta(hours=i % 3), i % 2) for i, (h, b) in texts.items()], SCHEMA)


def counted(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w and w not in C.STOP_WORDS]
    return Counter(search.query_terms(f"{w} {w}")[0] for w in words)


def brute(query, texts=TEXTS):
    terms = search.query_terms(query)
    held = {i: counted(f"{h or ''} {b or ''}") for i, (h, b) in texts.items()}
    df = Counter(t for c in held.values() for t in c)
    return {
        i: round(sum(c[t] / (c[t] + 1.2) * math.log(1 + len(texts) / df[t]) for t in terms), 6)
        for i, c in held.items() if terms and all(c[t] for t in terms)
    }


def test_token_counts(spark):
    rows = search.fts_tokens(articles(spark)).collect()
    assert len(rows) == len({(r.article_id, r.term) for r in rows})
    got = {i: {r.term: r.tf for r in rows if r.article_id == i} for i in TEXTS}
    assert got == {i: dict(counted(f"{h or ''} {b or ''}")) for i, (h, b) in TEXTS.items()}


@pytest.mark.parametrize("query", ["city vote", "cities voting", "policy", "the city", "party policies", "nowhere city", "the of"])
def test_matches_and_ranks(spark, tmp_path, query):
    index = search.build_index(articles(spark), f"{tmp_path}/index")
    assert {r.article_id: r.rank for r in search.search_match(index, query).collect()} == brute(query)
    assert search.search_total(index, query).first().total == len(brute(query))


def test_pages(spark, tmp_path):
    index = search.build_index(articles(spark), f"{tmp_path}/index")
    outlets = spark.createDataFrame([(0, "a"), (1, "b")], "outlet_id long, slug string")
    ranks = brute("city")
    at = {i: i % 3 for i in TEXTS}
    order = sorted(ranks, key=lambda i: (-ranks[i], -at[i], i))
    for page in (1, 2, 9):
        rows = search.search_ranked(index, articles(spark), outlets, "city", page=page, limit=4).collect()
        assert sorted(r.article_id for r in rows) == sorted(order[4 * page - 4 : 4 * page])
        assert all(r.total == len(ranks) and r.has_more == (4 * page < len(ranks)) for r in rows)
    with pytest.raises(ValueError):
        search.query_terms(" x ")


def test_only_buckets_and_row_groups_of_the_terms_are_read(spark, tmp_path, capsys):
    index = search.build_index(articles(spark), f"{tmp_path}/index")
    assert search.build_index(articles(spark).limit(0), index.path).weights(["city"]) == index.weights(["city"])  # written once
    index.postings(["city", "vote"]).explain()
    plan = capsys.readouterr().out
    assert "PartitionFilters: [bucket" in plan and re.search(r"PushedFilters: \[[^]]*In\(term, \[city,vote\]\)", plan)
    assert "full_text" not in plan and "Cartesian" not in plan


def test_no_articles(spark, tmp_path):
    index = search.build_index(articles(spark).limit(0), f"{tmp_path}/index")
    assert search.search_match(index, "city").collect() == [] and search.search_total(index, "city").first().total == 0


def test_postings_are_put_together_before_the_exchange(spark, tmp_path, monkeypatch):
    """Every posting of every part, with parts and batches far smaller than the articles of a term."""
    many = {i: ("City vote", "cities vote " * (i % 3)) for i in range(300)} | {65_536 + i: ("city", None) for i in range(20)}
    nameless = spark.createDataFrame([(None, "lost city", None, "u", None, 0)], SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        index = search.build_index(articles(spark, many).unionByName(nameless).repartition(3), f"{tmp_path}/index")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    stored = spark.read.parquet(f"{index.path}/postings").where("term = 'city' and block is not null").orderBy("block").collect()
    assert [r.offsets for r in stored] == [list(range(300)), list(range(20))]
    assert [r.tfs for r in stored] == [[1 + i % 3 for i in range(300)], [1] * 20]
    ranks = {r.article_id: r.rank for r in search.search_match(index, "city vote").collect()}
    assert ranks == {i: rank for i, rank in brute("city vote", many | {None: ("lost city", None)}).items()}
    small = search._part_postings(iter(articles(spark, many).selectExpr("article_id", "split(lower(headline), ' ') as words").toArrow().to_batches()))
    assert sum(b.num_rows for b in small) == 3  # city in two blocks and vote; an article at a time there were 620
