"""Main text of fetched pages.

The text of a page is what its <article> holds, or its <body> when it has none:
comments, scripts, styles, navigation, asides, headers, footers, forms and
tables go with all they hold, elements of their own kind included, block tags
end lines, other tags vanish, character references are decoded.  An opening or
closing tag without a partner drops nothing.  The whole page is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.functions import text

RAW = ("script", "style", "noscript")  # end at their first closing tag
DROPPED = ("nav", "table", "aside", "footer", "header", "form")
BLOCK = "(?is)</?(?:p|br|h[1-6]|li|ul|ol|div|section|blockquote|article|figure|figcaption)(?:[ \\t\\r\\n/][^>]*)?>"


def _flat(html: Column, tag: str) -> Column:
    return F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")


def without_elements(html: Column, tag: str, most: Column) -> Column:
    """``html`` with a line end for each outermost element of the tag, of which there are at most ``most``.

    The page is cut before each such tag.  ``depth`` counts the elements open after a cut; a piece lies inside an
    element that is closed later if the depth falls below its own further on.
    """
    opening, closing = rf"<{tag}\b[^>]*>", rf"</{tag}\s*>"

    def step(depths: Column, piece: Column) -> Column:
        now = F.coalesce(F.get(depths, F.size(depths) - 1), F.lit(0))
        now = F.when(piece.rlike(f"^(?i:{opening})"), now + 1).when(piece.rlike(f"^(?i:{closing})"), F.greatest(now - 1, F.lit(0))).otherwise(now)
        return F.concat(depths, F.array(now))

    def lowest(ends: Column, depth: Column) -> Column:
        return F.concat(ends, F.array(F.least(F.get(ends, F.size(ends) - 1), depth)))

    def kept(pieces: Column) -> Column:
        none = F.array().cast("array<int>")
        depths = F.aggregate(pieces, none, step)
        return text.let(depths, lambda d: text.let(
            F.reverse(F.aggregate(F.reverse(d), none, lowest)),
            lambda low: F.array_join(F.transform(pieces, lambda p, i: F.when(F.get(d, i) > F.get(low, i), "\n").otherwise(p)), ""),
        ))

    def cleaned(page: Column) -> Column:
        cut = F.split(page, f"(?i)(?={opening})|(?={closing})", -1)
        # With a single opening tag the element ends at the first closing one.
        return F.when(most == 0, page).when(most == 1, _flat(page, tag)).otherwise(text.let(cut, kept))

    return text.let(html, cleaned)


def main_text(html: Column) -> Column:
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in RAW:
        out = _flat(out, tag)

    def without_dropped(page: Column) -> Column:
        def each(found: Column) -> Column:
            rest = page
            for tag in DROPPED:
                rest = without_elements(rest, tag, F.size(found) - F.size(F.array_remove(found, tag)))
            return rest

        # One look at the page tells which of the tags it has at all; taking one kind out opens no other.
        return text.let(F.regexp_extract_all(F.lower(page), F.lit(rf"<({'|'.join(DROPPED)})\b")), each)

    out = text.let(out, without_dropped)

    def region(clean: Column) -> Column:
        inside = F.regexp_extract(clean, r"(?is)<article\b[^>]*>(.*)</article\s*>", 1)
        body = F.regexp_extract(clean, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)", 1)
        return text.let(inside, lambda x: F.when(x != "", x).otherwise(
            text.let(body, lambda y: F.when(y != "", y).otherwise(clean))))

    def lines(part: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(part, BLOCK, "\n"), "(?s)<[^>]*>", "")
        split = F.split(text.let(bare, text.unescape_html), "\n")
        tidy = F.transform(split, lambda l: text.strip(F.regexp_replace(l, rf"{text.SPACE}+", " ")))
        return F.array_join(F.filter(tidy, lambda l: l != ""), "\n")

    # Each step is bound once: the next one reads it more than once.
    joined = text.let(out, lambda clean: text.let(region(clean), lines))
    return text.let(joined, lambda x: F.when(x != "", x))


def article_main_text(pages: DataFrame) -> DataFrame:
    """Main text per page; null when nothing is left."""
    return pages.select("page_id", "url", main_text(F.col("html")).alias("main_text"))
