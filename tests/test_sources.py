"""Links, pages, feeds, upserts and answers on hand-made input."""

from datetime import datetime, timezone
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pressgrid.functions import text
from pressgrid.operators import validation
from pressgrid.sources import feeds, images, pages, upserts

BASE = "https://news.example/world/today/item?x=1"


@pytest.mark.parametrize("link", ["/a.jpg", "a.jpg", "../a.jpg", "../../../a.jpg", "./b/./c/../a.jpg", "//cdn.example/a.jpg", "?v=2", "https://x.example/p/../a.jpg", "sub/", ".."])
def test_links_resolve_like_the_standard_library(spark, link):
    got = spark.range(1).select(images.absolute_url(F.lit(link), F.lit(BASE)).alias("u")).first().u
    assert got == urljoin(BASE, link)


@pytest.mark.parametrize("link, expected", [
    (' "https://i.example/a.jpg#f" ', "https://i.example/a.jpg"),
    ("HTTPS://i.example/a.jpg?", "https://i.example/a.jpg"),
    ("/x.png", "https://news.example/x.png"),
    ("data:image/png;base64,xx", None), ("javascript:void(0)", None), ("", None), (None, None), ("https://", None),
    ("https://i.example/Logo.png", None), ("https://i.example/1x1.gif", None), ("https://i.example/ads/a.png", None),
    ("https://i.example/a.jpg?w=64&h=64", None), ("https://i.example/a.jpg?w=64", "https://i.example/a.jpg?w=64"),
    ("https://i.example/a.jpg?w=64&h=900", "https://i.example/a.jpg?w=64&h=900"),
    ("https://i.example/a.jpg?width=x&h=10", "https://i.example/a.jpg?width=x&h=10"),
])
def test_image_links(spark, link, expected):
    df = spark.createDataFrame([(link, BASE)], "l string, b string")
    assert images.image_url_clean(df, "l", "b").first().clean_url == expected


def test_page_image_prefers_og_and_stops_at_head(spark):
    rows = [
        (1, BASE, '<head><meta name="twitter:image" content="/t.jpg"><meta content="/o.jpg" property="og:image"></head>'),
        (2, BASE, '<head></head><body><meta property="og:image" content="/late.jpg"></body>'),
        (3, BASE, '<head><meta property="og:image" content="/logo.png"><meta name="twitter:image" content="/t.jpg"></head>'),
        (4, BASE, '<head><meta property="og:image" content="/a.jpg?a=1&amp;b=&#50;"><meta property="og:image" content="/z.jpg"></head>'),
        (5, BASE, None),
    ]
    got = {r.page_id: r.image_url for r in images.page_image_url(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "https://news.example/o.jpg", 2: None, 3: "https://news.example/t.jpg", 4: "https://news.example/a.jpg?a=1&b=2", 5: None}


def test_main_text(spark):
    html = "<body><nav>x</nav><!-- c --><article><h1>T &amp; T</h1><p>One <b>two</b>&nbsp;&#233;&#x1F600;</p><table><tr><td>no</td></tr></table><script>1<2</script><p> </p></article><p>out</p></body>"
    df = spark.createDataFrame([(1, "u", html), (2, "u", "<p>plain</p>"), (3, "u", "<body><script>x</script></body>")], "page_id long, url string, html string")
    assert [r.main_text for r in pages.article_main_text(df).orderBy("page_id").collect()] == ["T & T\nOne two é\U0001F600", "plain", None]


def test_nested_elements_go_whole(spark):
    many = "<table>" * 300 + "in" + "</table>" * 300
    cases = {
        "<body>a<table>b<table>c</table>d</table>e</body>": "a\ne",
        "<body>a<nav>b</nav>c<nav>d</nav>e</body>": "a\nc\ne",
        "<body>a<NAV class='x'>b<nav>c<nav>d</nav></nav>e</Nav >f</body>": "a\nf",
        "<body>a<table>b<nav>c<table>d</table></nav>e</table>f</body>": "a\nf",
        "<body>a<aside>b<aside>c</aside>d</body>": "ab\nd",  # the first has no end
        "<body>a</form>b<form>c<form>d</form></form>e</form>f</body>": "ab\nef",
        "<body>a<script>'<script>'</script>b</body>": "a\nb",
        f"<body>a{many}b{many}c</body>": "a\nb\nc",
    }
    df = spark.createDataFrame([(k, "u", html) for k, html in enumerate(cases)], "page_id long, url string, html string")
    assert [r.main_text for r in pages.article_main_text(df).orderBy("page_id").collect()] == list(cases.values())


def test_character_references(spark):
    from html import unescape

    from pressgrid.functions import text

    given = ["caf&eacute; &rarr; &NotEqualTilde; &CounterClockwiseContourIntegral;", "&noname; & &; &a; &&eacute;&eacute;", "&lt;&nbsp;&hellip;&Uuml;&#252;", "none", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k long, t string")
    got = [r.x for r in df.select("k", text.unescape_html(F.col("t")).alias("x")).orderBy("k").collect()]
    assert got == [None if t is None else unescape(t) for t in given]
    one = spark.createDataFrame([("&amp;eacute;&amp;lt;",)], "t string").select(text.unescape_html(F.col("t")).alias("x")).first()
    assert one.x == "&eacute;&lt;"


def test_other_kinds_of_feeds(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/">
      <entry><title type="text">One</title><link rel="self" href="https://a.example/feed"/><link href="https://a.example/1"/>
        <published>2024-01-02T10:00:00Z</published><author><name> Ann </name></author>
        <media:group><media:content medium="image" url="https://img.example/g.jpg"/></media:group></entry>
      <entry><title>No date</title><link href="https://a.example/2"/></entry></feed>"""
    rdf = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title></channel>
      <item><title>Two</title><link>https://b.example/1</link><dc:date>2024-01-02T11:30:00Z</dc:date><dc:creator>Bo</dc:creator></item></rdf:RDF>"""
    rss = """<rss><channel>
      <item><title>Three</title><guid>https://c.example/1</guid><pubDate>Tue, 02 Jan 2024 12:00:00 +0000</pubDate></item>
      <item><title>Four</title><guid isPermaLink="false">tag:4</guid><pubDate>Tue, 02 Jan 2024 12:00:00 +0000</pubDate></item></channel></rss>"""
    at = datetime(2024, 1, 2, tzinfo=timezone.utc)
    feed = spark.createDataFrame([("atom", at, 200, atom), ("rdf", at, 200, rdf), ("rss", at, 200, rss)], "outlet_slug string, fetched_at timestamp, http_status int, xml string")
    rows = feeds.feed_entries(feed).select("url", "headline", "author", F.date_format("published_at", "HH:mm"), "image_url").collect()
    assert sorted(map(tuple, rows)) == [
        ("https://a.example/1", "One", "Ann", "10:00", "https://img.example/g.jpg"),
        ("https://b.example/1", "Two", "Bo", "11:30", None),
        ("https://c.example/1", "Three", None, "12:00", None),
    ]
    assert {r.outlet_slug: (r.item_count, r.usable) for r in feeds.feed_health(feed).collect()} == {"atom": (2, True), "rdf": (1, True), "rss": (2, True)}


def test_feed_entries_and_health(spark):
    xml = """<rss xmlns:media="m"><channel>
      <item><title> A </title><link>https://n.example/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0530</pubDate><author> </author><media:thumbnail url="/t.jpg"/></item>
      <item><title>B</title><link>https://n.example/2</link><pubDate>2 Jan 2024 10:00:00 GMT</pubDate><enclosure url="https://n.example/e.mp3" type="audio/mpeg"/></item>
      <item><title>C</title><link>https://n.example/3</link><pubDate>never</pubDate></item>
      <item><title></title><link>https://n.example/4</link><pubDate>Tue, 02 Jan 2024 10:00:00</pubDate></item>
      <item><title>E</title><pubDate>Tue, 02 Jan 2024 10:00:00</pubDate></item></channel></rss>"""
    feed = spark.createDataFrame([("o", datetime(2024, 1, 2, tzinfo=timezone.utc), 200, xml), ("dead", datetime(2024, 1, 2, tzinfo=timezone.utc), 404, "")],
                                 "outlet_slug string, fetched_at timestamp, http_status int, xml string")
    got = feeds.feed_entries(feed).orderBy("url").select("headline", "author", F.date_format("published_at", "HH:mm").alias("at"), "image_url").collect()
    assert [tuple(r) for r in got] == [("A", None, "04:30", "https://n.example/t.jpg"), ("B", None, "10:00", None)]
    health = {r.outlet_slug: (r.item_count, r.first_headline, r.usable) for r in feeds.feed_health(feed).collect()}
    assert health == {"o": (5, "A", True), "dead": (0, None, False)}


def test_latest_wins_prefers_incoming_on_ties(spark):
    schema = "k long, v long, x string"
    got = upserts.latest_wins_upsert(spark.createDataFrame([(1, 1, "old"), (2, 5, "keep")], schema), spark.createDataFrame([(1, 1, "new"), (2, 4, "late"), (3, 1, "add")], schema), "k", "v")
    assert {r.k: r.x for r in got.collect()} == {1: "new", 2: "keep", 3: "add"}


def test_grounding_fold_is_idempotent(spark):
    raw = "  “Don’t” stop — now​…  "
    df = spark.createDataFrame([(raw,)], "s string").select(text.fold_for_grounding(F.col("s")).alias("a"))
    row = df.select("a", text.fold_for_grounding(F.col("a")).alias("b")).first()
    assert row.a == row.b == "\"don't\" stop - now..."


def test_answers_with_defaults_and_wrong_types(spark):
    good = '{"framing_score":0.5,"framing_label":"mixed","framing_confidence":1,"headline_sentiment":-1,"body_sentiment":"0.1","entities":{},"source_distribution":{"expert":"2"}}'
    rows = [(1, good), (2, good.replace("0.5", "true")), (3, good.replace('"entities":{}', '"entities":[]')), (4, good.replace('"2"', "2.5")), (5, None)]
    got = {r.article_id: r for r in validation.validate_enrichment(spark.createDataFrame(rows, "article_id long, response string")).collect()}
    assert got[1].is_valid and got[1].key_themes == [] and got[1].source_distribution.expert == 2 and float(got[1].body_sentiment) == 0.1
    assert got[2].is_valid and [got[i].reason for i in (3, 4, 5)] == ["bad_entities", "bad_source_distribution", "not_json"]


def test_backfill_outcomes(spark):
    articles = spark.createDataFrame([(k, 1, None, k) for k in range(1, 6)] + [(6, 1, "https://i/x.jpg", 6)], "article_id long, outlet_id long, image_url string, published_at long")
    image = '<head><meta property="og:image" content="https://img.example/a.jpg"></head>'
    fetched = [(1, "https://n.example/1", image, 200), (2, "https://n.example/2", "<p>x</p>", 200), (3, "https://n.example/3", image, 503), (4, "https://n.example/4", None, 200)]
    done = images.image_backfill(articles, spark.createDataFrame(fetched, "article_id long, url string, html string, http_status long"))
    got = {r.article_id: (r.image_url, r.outcome) for r in done.collect()}
    assert got == {1: ("https://img.example/a.jpg", "updated"), 2: (None, "no_image"), 3: (None, "http_failed"), 4: (None, "parse_failed"), 5: (None, "http_failed")}
    assert images.image_backfill_stats(done).first().asDict() == {"scanned": 5, "updated": 1, "no_image": 1, "http_failed": 2, "parse_failed": 1}
