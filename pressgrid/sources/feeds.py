"""RSS and Atom documents to entries, feed health, new-URL discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid import constants as C
from pressgrid.functions import text
from pressgrid.sources.images import feed_image

ITEM_SCHEMA = """struct<
  title: string, link: array<struct<_VALUE: string, _href: string, _rel: string, _type: string>>,
  guid: struct<_VALUE: string, _isPermaLink: string>,
  pubDate: string, published: string, `dc:date`: string,
  author: array<struct<_VALUE: string, name: string>>, `dc:creator`: array<string>,
  description: string, `content:encoded`: string, summary: string, content: string,
  image: string,
  `media:content`: array<struct<_url: string, _medium: string, _type: string>>,
  `media:thumbnail`: array<struct<_url: string>>,
  `media:group`: array<struct<
    `media:content`: array<struct<_url: string, _medium: string, _type: string>>,
    `media:thumbnail`: array<struct<_url: string>>>>,
  enclosure: array<struct<_url: string, _type: string>>>"""
# RSS 2.0 keeps its items in the channel, RSS 1.0 beside it; Atom calls them entries.
FEED_SCHEMA = f"channel struct<item: array<{ITEM_SCHEMA}>>, item array<{ITEM_SCHEMA}>, entry array<{ITEM_SCHEMA}>"
DATE_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm")


def parse_feed_date(raw: Column) -> Column:
    """RFC 822 or ISO date; a date without zone is UTC; null when unreadable."""
    bare = F.regexp_replace(text.strip(raw), r"^[A-Za-z]{3,9},\s*", "")
    tries = [F.try_to_timestamp(bare, F.lit(f)) for f in DATE_FORMATS]
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), bare.try_cast("timestamp"))
    return F.coalesce(*tries, iso)


def _items(feed: str) -> Column:
    """The items of a parsed feed, of whichever kind; null when it is no feed."""
    return F.coalesce(F.col(f"{feed}.channel.item"), F.col(f"{feed}.item"), F.col(f"{feed}.entry"))


def feed_items(raw_feeds: DataFrame) -> DataFrame:
    """Every item of the feeds answered with status 200, still raw."""
    parsed = raw_feeds.where("http_status = 200").select(
        "outlet_slug", "fetched_at", F.from_xml("xml", FEED_SCHEMA).alias("feed")
    )
    # Outer, so that no size test makes Spark parse each feed twice.
    items = parsed.select("outlet_slug", "fetched_at", F.posexplode_outer(_items("feed")).alias("item_no", "i"))
    return items.where("i is not null")


def feed_entries(raw_feeds: DataFrame, headline_chars: int = C.HEADLINE_CHARS) -> DataFrame:
    """Usable feed entries: with link, headline (its first ``headline_chars`` characters) and readable date.

    Without any image field ``image_url`` is null; the page step tries again.
    """
    i = F.col("i")
    links = F.coalesce(i["link"], F.array().cast("array<struct<_VALUE:string,_href:string,_rel:string,_type:string>>"))
    plain = F.try_element_at(F.filter(links, lambda e: e["_VALUE"].isNotNull()), F.lit(1))["_VALUE"]
    to_page = F.filter(links, lambda e: e["_href"].isNotNull() & (F.coalesce(e["_rel"], F.lit("alternate")) == "alternate"))
    href = F.try_element_at(to_page, F.lit(1))["_href"]
    guid = F.when(F.lower(F.coalesce(i["guid"]["_isPermaLink"], F.lit("true"))) != "false", i["guid"]["_VALUE"])
    creators = F.coalesce(i["dc:creator"], F.array().cast("array<string>"))
    authors = F.flatten(F.array(
        F.transform(F.coalesce(i["author"], F.array().cast("array<struct<_VALUE:string,name:string>>")), lambda a: F.coalesce(a["name"], a["_VALUE"])), creators
    ))
    named = F.try_element_at(F.filter(F.transform(authors, text.blank_to_null), lambda a: a.isNotNull()), F.lit(1))
    groups = i["media:group"]
    rows = feed_items(raw_feeds).select(
        "outlet_slug", "fetched_at", "item_no", "i",
        F.coalesce(text.blank_to_null(plain), text.blank_to_null(href), text.blank_to_null(guid)).alias("url"),
        text.blank_to_null(i["title"]).alias("headline"),
        named.alias("author"),
        F.coalesce(*(parse_feed_date(i[name]) for name in ("pubDate", "published", "dc:date"))).alias("published_at"),
    ).where("url is not null and headline is not null and published_at is not null")
    fields = {
        "media": F.coalesce(i["media:content"], F.flatten(groups["media:content"])),
        "thumbnails": F.coalesce(i["media:thumbnail"], F.flatten(groups["media:thumbnail"])),
        "enclosures": F.transform(i["enclosure"], lambda e: F.struct(e["_url"].alias("_href"), e["_type"].alias("_type"))),
        "links": i["link"],
        "image": i["image"],
        "html": [i["content:encoded"], i["content"], i["description"], i["summary"]],
    }
    return rows.select(
        "outlet_slug", "fetched_at", "item_no", "url",
        F.substring("headline", 1, headline_chars).alias("headline"),
        "author", "published_at", feed_image(fields, F.col("url")).alias("image_url"),
    )


def feed_health(raw_feeds: DataFrame) -> DataFrame:
    """Per feed: status, size, number of items, first headline, and whether it is usable."""
    feed = raw_feeds.select(
        "outlet_slug", "fetched_at", "http_status", F.octet_length("xml").cast("long").alias("bytes"),
        F.from_xml("xml", FEED_SCHEMA).alias("feed"),
    )
    items = F.coalesce(F.size(_items("feed")), F.lit(-1))
    count = F.greatest(items, F.lit(0)).cast("long")
    return feed.select(
        "outlet_slug", "fetched_at", "http_status", "bytes", count.alias("item_count"),
        text.blank_to_null(F.try_element_at(_items("feed"), F.lit(1))["title"]).alias("first_headline"),
        ((F.col("http_status") == 200) & (count >= 1)).alias("usable"),
    )


def discover_new_urls(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """Entries whose URL is new: the first entry of a URL wins, known URLs are left out.

    ``entries`` carries an ``arrival`` order.  A min_by aggregate keeps one row
    per URL before the shuffle, so a URL that repeats very often stays small.
    """
    columns = [c for c in entries.columns if c not in ("url", "arrival")]
    first = entries.groupBy("url").agg(F.min_by(F.struct(*columns), "arrival").alias("e"))
    return first.join(articles.select("url"), "url", "left_anti").select(
        "url", "e.*", F.lit("discovered").alias("processing_state"), F.lit(0).cast("long").alias("attempt_count")
    )
