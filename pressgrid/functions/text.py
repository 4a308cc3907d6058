"""Text columns: trimming, folding, token rule, HTML entities.

Everything here is a native column expression, so it stays inside the JVM.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

from pressgrid import constants as C

# Unicode white space, as a list of characters and as a pattern.  The pattern names
# the characters one by one: that is the fastest form for java.util.regex.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE = r"[ \t\n\x0B\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, for expressions that use it several times."""
    return F.transform(F.array(value), body)[0]


def strip(col: Column) -> Column:
    """Remove white space (Unicode) at both ends."""
    return F.trim(col, F.lit(SPACES))


def blank_to_null(col: Column) -> Column:
    stripped = strip(col)
    return F.nullif(stripped, F.lit(""))


def words(col: Column) -> Column:
    """Non-empty words of a text split at white space."""
    return F.filter(F.split(col, f"{SPACE}+"), lambda w: w != "")


def fold_for_grounding(col: Column) -> Column:
    """Fold quotes, dashes and spaces, collapse white space, lower; null becomes ''."""
    folded = F.translate(F.coalesce(col, F.lit("")), C.FOLD_FROM, C.FOLD_TO)
    folded = F.replace(folded, F.lit(C.ELLIPSIS), F.lit("..."))
    return F.lower(strip(F.regexp_replace(folded, f"{SPACE}+", " ")))


def title_from_key(col: Column) -> Column:
    """'tone_3' -> 'Tone 3': dashes and underscores to spaces, first letters raised."""
    spaced = F.regexp_replace(col, "[-_]", " ")
    pieces = F.split(spaced, r"(?<=\W)(?=\w)")
    raised = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(2, 1 << 30)))
    return F.array_join(raised, "")


# --- search terms ---------------------------------------------------------

def stem(word: Column) -> Column:
    """Light English suffix rule on a lowered word (plural, -ies, -ing, -ed)."""
    n = F.length(word)
    return (
        F.when((n > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y"))
        .when((n > 5) & word.endswith("ing"), F.regexp_replace(word, "ing$", ""))
        .when((n > 4) & word.endswith("ed"), F.regexp_replace(word, "ed$", ""))
        .when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


WORD_BREAK = r"[^\p{L}\p{N}]+"


def raw_terms(col: Column) -> Column:
    """Lowered alphanumeric runs of a text, in order."""
    return F.filter(F.split(F.lower(col), WORD_BREAK), lambda w: w != "")


def is_stop_word(word: Column) -> Column:
    return word.isin(*C.STOP_WORDS)


# --- HTML -------------------------------------------------------------------

NAMED_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ",
    "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&hellip;": "…",
}


# The standard's other names ('eacute;' -> 'é'), for a lookup; '&amp;' is decoded last of all.
OTHER_ENTITIES = json.dumps({name: sign for name, sign in html5.items() if name.endswith(";") and name != "amp;" and f"&{name}" not in NAMED_ENTITIES})
REFERENCE = "&[A-Za-z][A-Za-z0-9]{1,31};"


def _unescape_names(col: Column) -> Column:
    """Decode each named reference that the standard knows; others stay as they are."""
    names = F.from_json(F.lit(OTHER_ENTITIES), "map<string,string>")

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(piece, f"^{REFERENCE}", 0)
        sign = F.try_element_at(names, F.substr(name, F.lit(2)))
        rest = F.substr(piece, F.length(name) + 1)
        return F.when(name == "", piece).otherwise(F.coalesce(F.concat(sign, rest), piece))

    return F.array_join(F.transform(F.split(col, f"(?={REFERENCE})", -1), decode), "")


def unescape_html(col: Column) -> Column:
    """Decode numeric and named character references; '&amp;' last.

    ``col`` is read several times: bind it with ``let`` when it is costly.
    """
    pieces = F.split(col, r"(?=&#(?:\d{1,7}|[xX][0-9a-fA-F]{1,6});)|(?<=&#[0-9xXa-fA-F]{1,8};)")

    def decode(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#(\d{1,7});$", 1)
        hexes = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        code = F.when(digits != "", F.lpad(F.conv(digits, 10, 16), 8, "0")).when(
            hexes != "", F.lpad(hexes, 8, "0")
        )
        return F.coalesce(F.decode(F.unhex(code), "UTF-32"), piece)

    out = F.when(col.contains("&#"), F.array_join(F.transform(pieces, decode), "")).otherwise(col)
    for name, char in NAMED_ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    out = let(out, lambda x: F.when(x.rlike(f"(?!&amp;){REFERENCE}"), _unescape_names(x)).otherwise(x))
    return F.when(col.contains("&"), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(col)
