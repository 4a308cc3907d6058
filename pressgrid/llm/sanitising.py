"""Sanitising of personal data by information content.  DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card and phone numbers, found by rules.  A term that occurs
around an entity may give it away as well, so the corpus tells how strongly each term reveals each entity: texts are cut
at line and sentence ends into units of at most ``UNIT_WORDS`` words, and a term and an entity co-occur in the units that
hold both.  With IC the information content of an entity (minus the log2 of its share of units) and PMI the pointwise
mutual information of term and entity, IC - PMI bits are left to guess when the term is read, which is
log2(units with the term / units with both).  A term that leaves ``REMOVE_BITS`` or less about some entity is removed;
one that leaves ``GENERALISE_BITS`` or less, seen beside the entity in at least ``MIN_TEXTS`` different texts, is replaced by
its word shape; both wherever they occur outside the entities.  Limits of 2 ** bits keep the comparison in whole
numbers.  With 0 bits a removed term occurs beside the entity only, so texts without entities keep all their words.

Terms are runs of letters and digits (all characters beyond ASCII count as letters) with A-Z lower-cased.  Entities that cross the
end of a unit take no part in counting; they are found and replaced all the same.

The corpus is read once per kind of count: by units for terms beside entities, by units for how often a term occurs, and
by text for where revealing terms stand.  Texts are known by 128 bits of hash, so copies are marked once.  Counts are
sums that combine before any exchange, whatever one term, entity, text or source holds of all rows.

Cases: a null or empty text has no spans and its sanitised text is empty; repeated rows and rows with equal or null
doc_ids are judged one by one and get equal results for equal texts; copies count as co-occurrences but not as
different texts; overlapping spans of several kinds are all reported, and replaced by the mark of the first kind at
the earliest place; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrid.llm.store import let, stash

# The patterns that define each kind.
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The same matches in one pass over long runs: no group repeats by recursion, and no start inside a run that its own
# start has already refused (\G is the end of the match before).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
NEEDED = {"email": "@", "phone": "+"}  # a character that each match holds
TERM = "term"
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$"
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)

SPACES = r"[\x20\x09-\x0D]+"
UNIT_ENDS = r"[.!?]+[\x20\x09-\x0D]+|\n"
NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UNIT_WORDS = 32
MIN_TEXTS = 2
GENERALISE_BITS, REMOVE_BITS = 1, 0
TOTALS_BLOCK = 64
TEXT_KEY = ["h1", "h2"]
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _before(numbers: Column) -> Column:
    """Sum of the numbers before each number of an array, by blocks, so that long arrays stay cheap."""

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)

    def of_blocks(blocks: Column) -> Column:
        starts = F.aggregate(
            F.transform(blocks, total), F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
        )
        return let(
            starts,
            lambda s: F.flatten(F.transform(blocks, lambda block, b: F.transform(block, lambda _, i: F.get(s, b) + total(F.slice(block, 1, i))))),
        )

    def cut(values: Column) -> Column:
        n_blocks = F.ceil(F.size(values) / F.lit(TOTALS_BLOCK)).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(1), n_blocks), lambda b: F.slice(values, (b - 1) * TOTALS_BLOCK + 1, F.lit(TOTALS_BLOCK))
        )
        return F.when(F.size(values) > 0, let(blocks, of_blocks)).otherwise(F.array().cast("array<bigint>"))

    return let(numbers, cut)


def _places(text: Column, pattern: str, needed: str | None = None) -> Column:
    """array<struct<start, end, value>> of the matches of a pattern, in code points; each match holds ``needed``."""
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values")
    )

    def joined(x: Column) -> Column:
        steps = F.transform(x["values"], lambda v, i: (F.length(F.get(x["gaps"], i)) + F.length(v)).cast("long"))
        starts = F.zip_with(x["values"], _before(steps), lambda v, before: F.struct(v.alias("value"), before.alias("before")))
        return F.transform(
            starts,
            lambda y, i: let(
                y["before"] + F.length(F.get(x["gaps"], i)),
                lambda start: F.struct(start.alias("start"), (start + F.length(y["value"])).alias("end"), y["value"].alias("value")),
            ),
        )

    return F.when(text.rlike(pattern) if needed is None else text.contains(needed), let(parts, joined)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    )


def _luhn(digits: Column) -> Column:
    size = F.length(digits)
    weighed = F.transform(
        F.sequence(F.lit(1), size),
        lambda k: let(
            F.substring(digits, k, F.lit(1)).cast("int") * F.when((size - k) % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)
        ),
    )
    return F.aggregate(weighed, F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.when(F.length(digits).between(*CARD_DIGITS), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.translate(value, "+ ().-", "")).between(*PHONE_DIGITS)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the rules' spans: kinds as listed, then by place."""
    return F.concat(
        *(
            F.transform(
                F.filter(_places(text, PATTERNS[kind], NEEDED.get(kind)), lambda m: passes(kind, m["value"])),
                lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")),
            )
            for kind in KINDS
        )
    )


def entities(text: Column) -> Column:
    """Distinct values (``kind:value``) that a piece of text holds."""
    return F.array_distinct(
        F.concat(
            *(
                F.transform(
                    F.filter(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: passes(kind, m)),
                    lambda m: F.concat(F.lit(f"{kind}:"), m),
                )
                for kind in KINDS
            )
        )
    )


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text: Column) -> Column:
    """Distinct terms of a piece of text, outside all matches of the rules' patterns."""
    bare = text
    for kind in KINDS:
        bare = F.regexp_replace(bare, PATTERNS[kind], " ")
    return F.array_distinct(F.filter(F.split(_lower(bare), NO_TERM, -1), lambda w: w != ""))


def _any_match(text: Column) -> Column:
    found = F.lit(False)
    for kind in KINDS:
        held = text.contains(NEEDED[kind]) if kind in NEEDED else F.lit(True)
        found = found | (held & text.rlike(PATTERNS[kind]))
    return found


def units(documents: DataFrame) -> DataFrame:
    """(h1, h2, unit, marked): a row per piece of at most ``UNIT_WORDS`` words; ``marked`` if its text holds any match."""
    whole = documents.where("text is not null").select("text", *_text_key(F.col("text")), _any_match(F.col("text")).alias("marked"))
    sentence = F.split("text", UNIT_ENDS, -1)

    def pieces(words: Column) -> Column:
        last = F.ceil(F.size(words) / F.lit(UNIT_WORDS)).cast("int")
        cut = F.transform(F.sequence(F.lit(1), last), lambda k: F.array_join(F.slice(words, (k - 1) * UNIT_WORDS + 1, F.lit(UNIT_WORDS)), " "))
        return F.when(F.size(words) > 0, cut).otherwise(F.array().cast("array<string>"))

    of_sentence = F.transform(sentence, lambda s: let(F.filter(F.split(s, SPACES, -1), lambda w: w != ""), pieces))
    return whole.select(*TEXT_KEY, F.explode(F.flatten(of_sentence)).alias("unit"), "marked")


def term_units(pieces: DataFrame) -> DataFrame:
    """(term, n_units): units that hold each term."""
    plain = F.array_distinct(F.filter(F.split(_lower(F.col("unit")), NO_TERM, -1), lambda w: w != ""))
    terms = F.when(F.col("marked"), _terms(F.col("unit"))).otherwise(plain)
    return pieces.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_units"))


def together(pieces: DataFrame) -> DataFrame:
    """(entity, term, n_both, n_texts): units that hold both, and in how many different texts."""
    held = pieces.where("marked").select(*TEXT_KEY, "unit", entities(F.col("unit")).alias("held")).where(F.size("held") > 0)
    # The same unit of the same text becomes one row with a count, so copies never multiply the pairs.
    distinct = held.groupBy(*TEXT_KEY, "unit").agg(F.count(F.lit(1)).alias("n"), F.any_value("held").alias("held"))
    pairs = distinct.select(*TEXT_KEY, F.explode("held").alias("entity"), _terms(F.col("unit")).alias("terms"), "n").select(
        *TEXT_KEY, "entity", F.explode("terms").alias("term"), "n"
    )
    of_text = pairs.groupBy("entity", "term", *TEXT_KEY).agg(F.sum("n").alias("n"))
    return of_text.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_texts"))


def revealing_terms(
    documents: DataFrame, min_texts: int = MIN_TEXTS, generalise_bits: int = GENERALISE_BITS, remove_bits: int = REMOVE_BITS
) -> DataFrame:
    """(term, removed): terms that leave few bits to guess about some entity."""
    pieces = units(documents)
    pairs = stash(together(pieces), "entity-terms")
    removed = F.col("n_units") <= F.col("n_both") * (1 << remove_bits)
    generalised = (F.col("n_units") <= F.col("n_both") * (1 << generalise_bits)) & (F.col("n_texts") >= min_texts)
    judged = pairs.join(term_units(pieces), "term").where(removed | generalised)
    return judged.groupBy("term").agg(F.max(removed).alias("removed"))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def term_spans(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(h1, h2, marked): per text with revealing terms, their spans outside the rules' spans, with ``removed``."""
    texts = documents.where("text is not null").select("text", *_text_key(F.col("text")))
    own = F.array_distinct(F.filter(F.split(_lower(F.col("text")), NO_TERM, -1), lambda w: w != ""))
    # Copies of a text fall together before the exchange.
    hits = texts.select(*TEXT_KEY, F.explode(own).alias("term")).join(terms, "term").groupBy(*TEXT_KEY, "term").agg(F.any_value("removed").alias("removed"))
    hits = stash(hits, "text-terms")
    spans = F.concat(
        F.transform(base_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("term"))),
        F.transform(_places(F.col("text"), TERMS), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _lower(m["value"]).alias("term"))),
    )
    rows = texts.join(hits.select(*TEXT_KEY).distinct(), TEXT_KEY).select(*TEXT_KEY, F.inline(spans))
    found = (
        rows.join(hits, [*TEXT_KEY, "term"], "left")
        .where(F.col("term").isNull() | F.col("removed").isNotNull())
        .groupBy(*TEXT_KEY, "start", "end", "term", "removed")
        .agg(F.lit(1).alias("one"))
    )
    # Words don't overlap each other, so a span that begins inside a word is the next row of its text.
    rule = F.col("term").isNull()
    of_text = Window.partitionBy(*TEXT_KEY).orderBy("start", F.desc(rule), "end")
    reached = F.max(F.when(rule, F.col("end"))).over(of_text.rowsBetween(Window.unboundedPreceding, 0))
    free = found.select(*TEXT_KEY, "start", "end", "removed", rule.alias("rule"), reached.alias("reached"), F.lead("start").over(of_text).alias("next"))
    kept = free.where(~F.col("rule") & F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    return kept.groupBy(*TEXT_KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "removed"))).alias("marked"))


def digest(spans: str) -> Column:
    """``kind:start:end`` of the spans of an array column, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sanitised(text: Column, base: Column, marked: Column) -> Column:
    """The text with entities replaced by their kind, terms by their shape, and removed terms by nothing."""

    def shape(m: Column) -> Column:
        word = F.substring(text, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))
        return (
            F.when(m["removed"], "")
            .when(word.rlike("^[0-9]+$"), "[NUMBER]")
            .when(word.rlike(r"^\p{Lu}"), "[NAME]")
            .otherwise("[WORD]")
        )

    by_kind = F.create_map(*(F.lit(x) for item in MARKS.items() for x in item))
    replaced = F.array_sort(
        F.concat(
            F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by_kind[s["kind"]].alias("mark"))),
            F.transform(marked, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), shape(m).alias("mark"))),
        )
    )
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        new = F.when(s["start"] >= state["at"], F.array(gap, s["mark"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], new).alias("out"))

    whole = F.aggregate(
        replaced, begin, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    )
    return F.when(F.size(base) + F.size(marked) > 0, whole).otherwise(text)


def sanitise(
    documents: DataFrame, min_texts: int = MIN_TEXTS, generalise_bits: int = GENERALISE_BITS, remove_bits: int = REMOVE_BITS
) -> DataFrame:
    """(doc_id, base, spans, sanitised) per document.

    ``base`` holds the rules' spans and ``spans`` those and the revealing terms', as array<struct<kind, start, end>>.
    """
    terms = stash(revealing_terms(documents, min_texts, generalise_bits, remove_bits), "revealing-terms")
    of_text = stash(term_spans(documents, terms), "term-spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), *_text_key(text), base_spans(text).alias("base"))
    marked = F.coalesce("marked", F.array().cast("array<struct<start:bigint,end:bigint,removed:boolean>>"))
    joined = rows.join(of_text, TEXT_KEY, "left").select("doc_id", "text", "base", marked.alias("marked"))
    as_spans = F.transform("marked", lambda m: F.struct(F.lit(TERM).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    return joined.select(
        "doc_id",
        "base",
        F.concat("base", as_spans).alias("spans"),
        _sanitised(F.col("text"), F.col("base"), F.col("marked")).alias("sanitised"),
    )
