"""Quality rules with thresholds learned per language and source.  DataFrame functions only.

Every rate of a document is an integer.  A sketch of a rate is a histogram whose buckets keep the six leading
binary digits of the value, so a bucket is at most 1/32 wide relative to its value.  Sketches of any split of the rows
merge by adding counts, exactly and in any order.  A sketch's upper limit for a rate is
``q90 + 2 * (q90 - q50) + floor``: slack grows with the spread of the sketch's own upper half, and the small floor only
keeps a rate that is zero almost everywhere from failing a document by its first symbol or line.  Limits of few rows are
unsure, so a group's limit is the mean of its own and its language's, weighted by its rows and ``prior_rows``, and a
language's is blended with that of all rows alike: no group size switches the rule.

Cases: null text has no words; a document without words fails the base rule; null languages and sources are groups of
their own; repeated rows are judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.llm.store import let, stash

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

MIDDLE, UPPER, SPREADS = 50, 90, 2
PRIOR_ROWS = 200

# rate -> (expression over the counts, floor of the slack)
RATES = {
    "symbol_rate": ("n_symbols * 1000 div greatest(n_words, 1)", 20),
    "repeat_rate": ("n_repeat_words * 1000 div greatest(n_words, 1)", 100),
    "dup_line_rate": ("n_dup_lines * 1000 div greatest(n_words, 1)", 20),
    "word_length": ("word_chars * 100 div greatest(n_words, 1)", 50),
}


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of ``WINDOW`` words that occur twice or more among ``words``."""

    def covered(keys: Column) -> Column:
        by_key = F.sort_array(F.transform(keys, lambda key, at: F.struct(key.alias("key"), at.alias("at"))))

        def count(ranked: Column) -> Column:
            repeated = F.filter(
                ranked,
                lambda x, i: F.get(ranked, i - 1)["key"].eqNullSafe(x["key"]) | F.get(ranked, i + 1)["key"].eqNullSafe(x["key"]),
            )
            places = F.sort_array(F.transform(repeated, lambda x: x["at"]))
            return let(
                places,
                lambda p: F.aggregate(
                    F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW)))),
                    F.lit(0).cast("long"),
                    lambda total, step: total + step,
                ),
            )

        some = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(some, let(by_key, count)).otherwise(F.lit(0).cast("long"))

    # A window is known by a 64-bit hash of its words' hashes, compared inside one document only.
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    keys = let(
        hashes,
        lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))),
    )
    return F.when(F.size(words) > WINDOW, let(keys, covered)).otherwise(F.lit(0).cast("long"))


def base_counts(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACES, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = documents.select(
        "doc_id",
        "lang",
        "source",
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeat"))).alias("of_words"),
    )
    return counts.select(
        "doc_id",
        "lang",
        "source",
        F.col("of_words.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("of_words.repeat").alias("n_repeat_words"),
    ).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def rate_sketches(counts: DataFrame) -> DataFrame:
    """lang, source, rate, bucket, n: one mergeable histogram per group and rate."""
    rates = F.array(*(F.struct(F.lit(name).alias("rate"), F.expr(rule).alias("value")) for name, (rule, _) in RATES.items()))
    bucket = "if(value < 64, value, shiftleft(shiftright(value, length(bin(value)) - 6), length(bin(value)) - 6))"
    return (
        counts.select("lang", "source", F.inline(rates))
        .withColumn("bucket", F.expr(bucket))
        .groupBy("lang", "source", "rate", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def sketch_limits(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the sketches by ``keys`` and rate: keys, rate, upper limit, rows."""
    merged = sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    # At most 2 000 buckets a group and rate, whatever the number of rows.
    steps = merged.groupBy(*keys, "rate").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("steps"), F.sum("n").alias("rows")
    )

    def quantile(percent: int) -> Column:
        """Smallest bucket with at least ``percent`` % of the rows at or below it."""
        found = F.aggregate(
            "steps",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("value")),
            lambda state, step: F.struct(
                (state["seen"] + step["n"]).alias("seen"),
                F.coalesce(
                    state["value"], F.when(100 * (state["seen"] + step["n"]) >= percent * F.col("rows"), step["bucket"])
                ).alias("value"),
            ),
        )
        return found["value"]

    floor = F.create_map(*(F.lit(x) for name, (_, floor) in RATES.items() for x in (name, floor)))
    middle, high = F.col("middle"), F.col("high")
    return steps.withColumn("middle", quantile(MIDDLE)).withColumn("high", quantile(UPPER)).select(
        *keys, "rate", (high + SPREADS * (high - middle) + floor[F.col("rate")]).alias("upper"), "rows"
    )


def blended_limits(sketches: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """lang, source, rate, upper: each group's limit, drawn towards its language's and that one's towards all rows'."""

    def drawn(own: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
        parent = parent.select(F.col("rate").alias("of_rate"), F.col("upper").alias("above"), *(F.col(k).alias(f"of_{k}") for k in keys))
        same = F.col("rate") == F.col("of_rate")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
        mean = F.expr(f"(rows * upper + {int(prior_rows)} * above) div (rows + {int(prior_rows)})")
        return own.join(parent, same).withColumn("upper", mean).select(*own.columns)

    languages = drawn(sketch_limits(sketches, ["lang"]), sketch_limits(sketches, []), [])
    return drawn(sketch_limits(sketches, ["lang", "source"]), languages, ["lang"]).drop("rows")


def quality_rules(documents: DataFrame, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Counts, base rule and the verdict of the learned limits, one row per document."""
    counts = stash(base_counts(documents), "rule-counts")
    # One row per group, rate and bucket: all limits are taken from this small table.
    limits = blended_limits(stash(rate_sketches(counts), "rule-sketches"), prior_rows)
    limits = (
        limits.groupBy("lang", "source")
        .agg(*(F.max(F.when(F.col("rate") == name, F.col("upper"))).alias(f"max_{name}") for name in RATES))
        .select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *(f"max_{name}" for name in RATES))
    )
    within = F.lit(True)
    for name, (rule, _) in RATES.items():
        within = within & (F.expr(rule) <= F.col(f"max_{name}"))
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & within).alias("kept"),
    )
