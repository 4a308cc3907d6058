"""Validation of model answers: typed rows, or the reason why not.

An answer is a JSON text.  It is read as a VARIANT, so that wrong types are
seen as such instead of being coerced away; every check is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid import constants as C

NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")
ENRICH_KEYS = (
    "framing_score", "framing_label", "framing_confidence", "headline_sentiment", "body_sentiment",
    "key_themes", "entities", "quoted_sources", "source_distribution", "evidence_snippets",
)
ENRICH_RANGES = {
    "framing_score": -1.0, "framing_confidence": 0.0, "headline_sentiment": -1.0, "body_sentiment": -1.0,
}
QUOTE_KEYS = ("speaker", "affiliation", "quote", "stance")
COMPARE_KEYS = ("differences", "coverage_matrix", "not_present_here")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), r"^[A-Z]+", 0)


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _fields(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _items(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _only(v: Column, keys: tuple[str, ...]) -> Column:
    """True when an object has no key outside ``keys``."""
    return F.size(F.array_except(F.map_keys(_fields(v)), F.array(*[F.lit(k) for k in keys]))) == 0


def _string_list(v: Column) -> Column:
    return (_kind(v) == "") | ((_kind(v) == "ARRAY") & F.forall(_items(v), lambda x: _kind(x) == "STRING"))


def _number(v: Column) -> Column:
    """Numeric value; numeric strings and booleans count, as the answers' schema is lenient there."""
    return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(_kind(v).isin(*NUMERIC, "STRING"), F.try_variant_get(v, "$", "string").try_cast("double"))


def _in_range(v: Column, low: float) -> Column:
    n = _number(v)
    return F.coalesce((n >= low) & (n <= 1.0) & ~F.isnan(n), F.lit(False))


def _whole(v: Column) -> Column:
    n = _number(v)
    return (_kind(v) == "") | F.coalesce((n >= 0) & (n == F.floor(n)), F.lit(False))


def validate_enrichment(responses: DataFrame) -> DataFrame:
    """(article_id, is_valid, reason, typed fields) for each answer; the first broken rule names the reason."""
    v = F.col("v")
    checks: list[tuple[Column, str]] = [
        (v.isNull(), "not_json"),
        (_kind(v) != "OBJECT", "not_an_object"),
        (~_only(v, ENRICH_KEYS), "extra_key"),
    ]
    for key, low in ENRICH_RANGES.items():
        checks.append((~_in_range(_get(v, key), low), f"bad_{key}"))
    label = _get(v, "framing_label")
    checks.append((~((_kind(label) == "STRING") & F.try_variant_get(label, "$", "string").isin(*C.FRAMING_LABELS)), "bad_framing_label"))
    checks.append((~_string_list(_get(v, "key_themes")), "bad_key_themes"))
    ent = _get(v, "entities")
    bad_entities = (_kind(ent) != "OBJECT") | ~_only(ent, C.ENTITY_KINDS)
    for k in C.ENTITY_KINDS:
        bad_entities = bad_entities | ~_string_list(_get(ent, k))
    checks.append((bad_entities, "bad_entities"))
    quotes = _get(v, "quoted_sources")

    def good_quote(q: Column) -> Column:
        return (
            (_kind(q) == "OBJECT") & _only(q, QUOTE_KEYS)
            & (_kind(_get(q, "speaker")) == "STRING") & (_kind(_get(q, "quote")) == "STRING")
            & _kind(_get(q, "affiliation")).isin("", "VOID", "STRING")
            & F.coalesce(F.try_variant_get(q, "$.stance", "string").isin(*C.QUOTE_STANCES), F.lit(False))
        )

    checks.append((~((_kind(quotes) == "") | ((_kind(quotes) == "ARRAY") & F.forall(_items(quotes), good_quote))), "bad_quoted_sources"))
    dist = _get(v, "source_distribution")
    bad_dist = (_kind(dist) != "OBJECT") | ~_only(dist, C.SOURCE_CATEGORIES)
    for c in C.SOURCE_CATEGORIES:
        bad_dist = bad_dist | ~_whole(_get(dist, c))
    checks.append((bad_dist, "bad_source_distribution"))
    checks.append((~_string_list(_get(v, "evidence_snippets")), "bad_evidence_snippets"))

    reason = F.when(checks[0][0], checks[0][1])
    for broken, name in checks[1:]:
        reason = reason.when(broken, name)
    judged = responses.select("article_id", F.try_parse_json("response").alias("v")).withColumn("reason", reason)
    valid = F.col("reason").isNull()

    def number(key: str) -> Column:
        return F.when(valid, _number(_get(v, key)).cast("decimal(3,2)")).alias(key)

    def listed(value: Column, item: str) -> Column:
        return F.when(valid, F.coalesce(F.try_variant_get(value, "$", f"array<{item}>"), F.array().cast(f"array<{item}>")))

    return judged.select(
        "article_id", valid.alias("is_valid"), "reason",
        number("framing_score"),
        F.when(valid, F.try_variant_get(v, "$.framing_label", "string")).alias("framing_label"),
        number("framing_confidence"), number("headline_sentiment"), number("body_sentiment"),
        listed(_get(v, "key_themes"), "string").alias("key_themes"),
        F.struct(*[listed(_get(ent, k), "string").alias(k) for k in C.ENTITY_KINDS]).alias("entities"),
        listed(quotes, "struct<speaker:string,affiliation:string,quote:string,stance:string>").alias("quoted_sources"),
        F.struct(*[
            F.when(valid, F.coalesce(_number(_get(dist, c)), F.lit(0.0)).cast("long")).alias(c) for c in C.SOURCE_CATEGORIES
        ]).alias("source_distribution"),
        listed(_get(v, "evidence_snippets"), "string").alias("evidence_snippets"),
    )


def validate_comparison(responses: DataFrame) -> DataFrame:
    """(story_id, is_valid, reason, differences, coverage_matrix, not_present_here) per answer."""
    v = F.col("v")
    diff, matrix, gaps = (_get(v, k) for k in COMPARE_KEYS)

    def good_cell(theme: Column, score: Column) -> Column:
        return _in_range(score, 0.0)

    good_matrix = (_kind(matrix) == "") | (
        (_kind(matrix) == "OBJECT")
        & F.forall(F.map_values(_fields(matrix)), lambda cell: (_kind(cell) == "OBJECT") & F.forall(F.map_values(_fields(cell)), lambda s: _in_range(s, 0.0)))
    )
    good_gaps = (_kind(gaps) == "") | (
        (_kind(gaps) == "OBJECT") & F.forall(F.map_values(_fields(gaps)), lambda g: (_kind(g) == "ARRAY") & _string_list(g))
    )
    blank = F.coalesce(F.trim(F.regexp_replace(F.try_variant_get(diff, "$", "string"), r"\s", "")) == "", F.lit(True))
    reason = (
        F.when(v.isNull(), "not_json")
        .when(_kind(v) != "OBJECT", "not_an_object")
        .when(~_only(v, COMPARE_KEYS), "extra_key")
        .when((_kind(diff) != "STRING") | blank, "blank_differences")
        .when(~good_matrix, "bad_coverage_matrix")
        .when(~good_gaps, "bad_not_present_here")
    )
    judged = responses.select("story_id", F.try_parse_json("response").alias("v")).withColumn("reason", reason)
    valid = F.col("reason").isNull()
    numbers = F.transform_values(_fields(matrix), lambda k, cell: F.transform_values(_fields(cell), lambda t, s: _number(s)))
    lists = F.transform_values(_fields(gaps), lambda k, g: F.try_variant_get(g, "$", "array<string>"))
    return judged.select(
        "story_id", valid.alias("is_valid"), "reason",
        F.when(valid, F.try_variant_get(diff, "$", "string")).alias("differences"),
        F.when(valid, numbers).alias("coverage_matrix"),
        F.when(valid, lists).alias("not_present_here"),
    )
