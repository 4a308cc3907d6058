"""Image links from pages and feeds: cleaning, choosing, backfill.

Native expressions only; URLs are read with patterns, relative ones resolved
against their page.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid import constants as C
from pressgrid.functions import text
from pressgrid.operators.filters import bounded

BAD_URL = "|".join(re.escape(s).replace(r"\-", "-").replace("/", "/") for s in C.IMAGE_BAD_SUBSTRINGS)
IMAGE_FILE = "(?:" + "|".join(e.replace(".", r"\.") for e in C.IMAGE_EXTENSIONS) + ")$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _resolve_dots(path: Column) -> Column:
    """Apply '.' and '..' segments of an absolute path."""
    segments = F.slice(F.split(path, "/"), 2, 1 << 30)

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_in_dots = F.element_at(segments, -1).isin(".", "..")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_in_dots & (F.size(kept) > 0), "/").otherwise(""))


def absolute_url(link: Column, base: Column) -> Column:
    """``link`` seen from the page at ``base``; unchanged when it has a scheme or there is no base."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_replace(F.when(base_path == "", "/").otherwise(base_path), "[^/]*$", "")
    link_path = F.regexp_extract(link, r"^([^?#]*)", 1)
    link_rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    joined = F.when(link_path.startswith("/"), link_path).otherwise(F.concat(folder, link_path))
    return (
        F.when(link.rlike(SCHEME), link)
        .when(F.coalesce(root, F.lit("")) == "", link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link_path == "", F.concat(root, base_path, F.when(link_rest.startswith("?"), link_rest).otherwise(F.concat(base_query, link_rest))))
        .otherwise(F.concat(root, _resolve_dots(joined), link_rest))
    )


def _stated_side(query: Column, names: str) -> Column:
    value = F.regexp_extract(query, rf"(?i)(?:^|&)(?:{names})=([^&]*)", 1)
    return F.trim(value).try_cast("long")


def clean_image_url(link: Column, base: Column | None = None) -> Column:
    """A usable absolute http(s) image URL, or null.

    Drops quotes and fragment; rejects other schemes, missing hosts, links that
    look like logos, trackers or advertising, and links that state both sides
    below 200 pixels.
    """
    bare = F.regexp_replace(F.regexp_replace(text.strip(link), '^"+|"+$', ""), "^'+|'+$", "")

    def judge(scheme: Column, after: Column) -> Column:
        query = F.regexp_extract(after, r"\?(.*)$", 1)
        small = (_stated_side(query, "w|width") < C.IMAGE_MIN_SIDE) & (_stated_side(query, "h|height") < C.IMAGE_MIN_SIDE)
        url = F.concat(scheme, F.lit(":"), after)
        # Cheap tests first: most rejected links never reach the query string.
        ok = scheme.isin("http", "https") & after.rlike("^//[^/?#]") & ~F.lower(url).rlike(BAD_URL)
        return F.when(ok & F.when(after.contains("?"), ~F.coalesce(small, F.lit(False))).otherwise(True), url)

    def without_fragment(full: Column) -> Column:
        scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        after = F.regexp_replace(F.regexp_replace(full, SCHEME, ""), r"#.*$|\?(?:#.*)?$", "")
        return text.let(scheme, lambda s: text.let(after, lambda a: judge(s, a)))

    def resolved(link: Column) -> Column:
        return link if base is None else absolute_url(link, base)

    return F.when(
        text.blank_to_null(link).isNotNull(),
        text.let(bare, lambda b: F.when(b != "", text.let(resolved(b), without_fragment))),
    )


def looks_like_image(url: Column) -> Column:
    return F.split_part(F.lower(url), F.lit("?"), F.lit(1)).rlike(IMAGE_FILE)


def image_url_clean(df: DataFrame, url_col: str, base_col: str | None = None) -> DataFrame:
    base = F.col(base_col) if base_col else None
    return df.withColumn("clean_url", clean_image_url(F.col(url_col), base))


# --- from pages -----------------------------------------------------------------


def _tags(html: Column, name: str) -> Column:
    """All opening tags of a name, with whatever their quoted values hold."""
    return F.regexp_extract_all(html, F.lit(rf"""(?i)<{name}\b(?:[^>"']|"[^"]*"|'[^']*')*>"""), 0)


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or bare, with entities decoded; '' when absent."""
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)])
    return text.strip(text.let(value, lambda v: F.when(v.contains("&"), text.unescape_html(v)).otherwise(v)))


def page_image_url(pages: DataFrame) -> DataFrame:
    """Each page's og:image, else twitter:image, from its head, cleaned; null when none is usable."""
    head = F.regexp_extract(F.col("html"), r"(?is)^(.*?)(?:</head|$)", 1)
    tags = pages.select(
        "page_id", "url",
        F.transform(
            _tags(head, "meta"),
            lambda tag: F.struct(
                F.lower(_attribute(tag, "property")).alias("property"),
                F.lower(_attribute(tag, "name")).alias("name"),
                _attribute(tag, "content").alias("content"),
            ),
        ).alias("tags"),
    )

    def is_og(t: Column) -> Column:
        return t["property"].isin(*C.OG_PROPERTIES) | t["name"].isin(*C.OG_NAMES)

    def is_twitter(t: Column) -> Column:
        return ~is_og(t) & (t["property"].isin(*C.TWITTER_NAMES) | t["name"].isin(*C.TWITTER_NAMES))

    def first(rule) -> Column:
        return F.try_element_at(F.filter("tags", lambda t: (t["content"] != "") & rule(t)), F.lit(1))["content"]

    found = tags.select("page_id", "url", first(is_og).alias("og"), first(is_twitter).alias("twitter"))
    return found.select(
        "page_id", "url",
        F.coalesce(clean_image_url(F.col("og"), F.col("url")), clean_image_url(F.col("twitter"), F.col("url"))).alias("image_url"),
    )


def image_backfill(
    articles: DataFrame, pages: DataFrame, limit: int = 100, outlet_id: int | None = None
) -> DataFrame:
    """Image links for the oldest articles without one, from their pages.

    ``pages`` has (article_id, url, html, http_status).  Result per scanned
    article: the new link and what happened; ``parse_failed`` is a page that
    arrived without a body to read.  ``limit`` lies in 1..10000.
    """
    bounded("limit", limit, 10_000)
    waiting = articles.where("image_url is null")
    if outlet_id is not None:
        waiting = waiting.where(F.col("outlet_id") == outlet_id)
    batch = waiting.orderBy("published_at", "article_id").limit(limit).select("article_id")
    fetched = pages.join(F.broadcast(batch), "article_id", "left_semi")  # limit rows
    found = page_image_url(
        fetched.where("http_status = 200").select(F.col("article_id").alias("page_id"), "url", "html")
    ).select(F.col("page_id").alias("article_id"), "image_url")
    status = fetched.select("article_id", "http_status", F.col("html").isNull().alias("unreadable"))
    joined = batch.join(status, "article_id", "left").join(found, "article_id", "left")
    outcome = (
        F.when(F.coalesce("http_status", F.lit(0)) != 200, "http_failed")
        .when(F.col("unreadable"), "parse_failed")
        .when(F.col("image_url").isNull(), "no_image")
        .otherwise("updated")
    )
    return joined.select("article_id", "image_url", outcome.alias("outcome"))


def image_backfill_stats(backfill: DataFrame) -> DataFrame:
    return backfill.agg(
        F.count(F.lit(1)).alias("scanned"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("updated", "no_image", "http_failed", "parse_failed")],
    )


# --- from feed entries --------------------------------------------------------------

def _inline_image(html: Column) -> Column:
    """Address of the first picture in a piece of html."""
    found = F.transform(_tags(F.coalesce(html, F.lit("")), "img"), lambda tag: _attribute(tag, "src"))
    return F.try_element_at(F.filter(found, lambda link: link != ""), F.lit(1))


def feed_image(entry: dict[str, Column], base: Column) -> Column:
    """First usable image of a feed entry, by the order of preference of its fields."""
    strings = F.array().cast("array<string>")

    def low(c: Column) -> Column:
        return F.lower(F.coalesce(c, F.lit("")))

    media_type = lambda m: (low(m["_medium"]) == "image") | low(m["_type"]).startswith("image/")
    untyped = lambda m: (low(m["_medium"]) == "") & (low(m["_type"]) == "") & looks_like_image(m["_url"])
    picture = lambda e: low(e["_type"]).startswith("image/") | F.coalesce(looks_like_image(e["_href"]), F.lit(False))
    media = F.transform(F.filter(entry["media"], lambda m: media_type(m) | F.coalesce(untyped(m), F.lit(False))), lambda m: m["_url"])
    thumbs = F.transform(entry["thumbnails"], lambda t: t["_url"])
    enclosures = F.transform(F.filter(entry["enclosures"], picture), lambda e: e["_href"])
    links = F.transform(
        F.filter(entry["links"], lambda e: (low(e["_rel"]) == "enclosure") & picture(e)), lambda e: e["_href"]
    )
    inline = F.array(*(_inline_image(c) for c in entry["html"]))
    candidates = F.concat(
        *[F.coalesce(c, strings) for c in (media, thumbs, enclosures, links)], F.array(entry["image"]), inline
    )
    cleaned = F.filter(F.transform(candidates, lambda u: clean_image_url(u, base)), lambda u: u.isNotNull())
    return F.try_element_at(cleaned, F.lit(1))
