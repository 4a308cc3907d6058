"""Label folding: framing labels and buckets, rating labels, stances, source categories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pressgrid import constants as C
from pressgrid.functions.text import strip


def framing_label(col: Column) -> Column:
    """One of the six display labels, or null."""
    folded = F.lower(strip(col))
    return F.when(folded.isin(*C.DISPLAY_LABELS), folded)


def framing_bucket(mean_score: Column) -> Column:
    return (
        F.when(mean_score <= -C.FRAMING_BUCKET_CUT, "critical")
        .when(mean_score >= C.FRAMING_BUCKET_CUT, "supportive")
        .when(mean_score.isNotNull(), "neutral")
    )


def bias_category(source: Column, label: Column) -> Column:
    """left / center / right for a known (rating source, label), else null."""
    entries = [F.lit(x) for (src, lab), cat in C.BIAS_LABELS.items() for x in (f"{src}|{lab}", cat)]
    key = F.concat(F.trim(source), F.lit("|"), F.lower(F.trim(F.coalesce(label, F.lit("")))))
    return F.try_element_at(F.create_map(*entries), key)


def _looked_up(table: dict[str, str], key: Column, default: str) -> Column:
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def quote_stance(col: Column) -> Column:
    return _looked_up(C.STANCE_WORDS, F.lower(strip(col)), "unknown")


def source_category(col: Column) -> Column:
    """One of the fixed categories; blanks and hyphens between words count as one underscore."""
    blank = F.translate(F.lower(strip(col)), "-\t\n\x0b\f\r", " " * 6)
    folded = F.array_join(F.filter(F.split(blank, " "), lambda part: part != ""), "_")
    return _looked_up({c: c for c in C.SOURCE_CATEGORIES}, F.when(blank == F.btrim(blank), folded), "other")
