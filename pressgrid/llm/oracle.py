"""DuckDB SQL for the registered queries of this subpackage that SQL can express."""

from __future__ import annotations

from pressgrid.llm import sanitising
from pressgrid.llm.quality_rules import MAX_REPEAT_PERCENT, MIDDLE, MIN_WORDS, PRIOR_ROWS, RATES, SPREADS, UPPER, WINDOW

_WORD_LISTS = r"""
words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         row_number() OVER () AS rn
  FROM documents)"""


def quality_rules_sql(prior_rows: int = PRIOR_ROWS) -> str:
    rates = [(name, rule.replace(" div ", " // "), floor) for name, (rule, floor) in RATES.items()]
    values = " UNION ALL ".join(f"SELECT rn, lang, source, '{name}' AS rate, {rule} AS value FROM counts" for name, rule, _ in rates)
    floor = " ".join(f"WHEN '{name}' THEN {floor}" for name, _, floor in rates)
    high = f"quantile_disc(bucket, {UPPER / 100})"
    limit = f"count(*) AS n_rows, {high} + {SPREADS} * ({high} - quantile_disc(bucket, {MIDDLE / 100})) + CASE rate {floor} END AS upper"
    mean = lambda own, above: f"({own}.n_rows * {own}.upper + {prior_rows} * {above}.upper) // ({own}.n_rows + {prior_rows}) AS upper"
    return rf"""
WITH {_WORD_LISTS},
windows AS (
  SELECT rn, i, list_aggregate(w[i:i + {WINDOW - 1}], 'string_agg', ' ') AS win
  FROM words, unnest(range(1, len(w) - {WINDOW - 2})) AS r(i) WHERE len(w) >= {WINDOW}),
again AS (
  SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS following
  FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rn, sum(least({WINDOW}, coalesce(following - i, {WINDOW}))) AS n FROM again GROUP BY rn),
lines AS (
  SELECT rn, count(*) - count(DISTINCT line) AS n
  FROM words, unnest(string_split(text, chr(10))) AS l(line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rn),
counts AS (
  SELECT words.rn, doc_id, lang, source, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM words LEFT JOIN lines USING (rn) LEFT JOIN repeats USING (rn)),
rated AS ({values}),
bucketed AS (
  SELECT *, CASE WHEN value < 64 THEN value
                 ELSE (value >> (length(bin(value)) - 6)) << (length(bin(value)) - 6) END AS bucket FROM rated),
whole AS (SELECT rate, {limit} FROM bucketed GROUP BY rate),
of_lang AS (SELECT lang, rate, {limit} FROM bucketed GROUP BY lang, rate),
own AS (SELECT lang, source, rate, {limit} FROM bucketed GROUP BY lang, source, rate),
languages AS (SELECT lang, rate, {mean("of_lang", "whole")} FROM of_lang JOIN whole USING (rate)),
limits AS (
  SELECT own.lang, own.source, own.rate, {mean("own", "languages")}
  FROM own JOIN languages ON own.rate = languages.rate AND own.lang IS NOT DISTINCT FROM languages.lang),
broken AS (
  SELECT DISTINCT r.rn FROM rated r JOIN limits USING (rate)
  WHERE r.lang IS NOT DISTINCT FROM limits.lang AND r.source IS NOT DISTINCT FROM limits.source AND r.value > limits.upper),
base AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rn NOT IN (SELECT rn FROM broken) AS kept
FROM base"""


EXACT_DEDUP = r"""
WITH normal AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(normal) AS text_sha256
FROM normal WINDOW same AS (PARTITION BY normal)"""


SUBSTRING_DEDUP = rf"""
WITH {_WORD_LISTS},
windows AS (
  SELECT rn, doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS win
  FROM words, unnest(range(1, len(w) - 11)) AS r(i) WHERE len(w) >= 13),
later AS (SELECT rn, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT rn, list(DISTINCT i + k) AS places FROM later, unnest(range(0, 13)) AS r(k) GROUP BY rn),
kept AS (
  SELECT doc_id, rn, w, p, w[p] AS word FROM words LEFT JOIN gone USING (rn), unnest(range(1, len(w) + 1)) AS r(p)
  WHERE places IS NULL OR NOT list_contains(places, p)),
joined AS (SELECT rn, string_agg(word, ' ' ORDER BY p) AS text FROM kept GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
       sha256(coalesce(joined.text, '')) AS kept_sha256
FROM words LEFT JOIN gone USING (rn) LEFT JOIN joined USING (rn)"""


CHAT_FORMAT = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, role, text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
chats AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY k) AS said, count(*) AS n_turns FROM turns GROUP BY conv_id),
starts AS (SELECT DISTINCT said[1:k] AS said FROM chats, unnest(range(1, n_turns)) AS r(k)),
kept AS (
  SELECT min(conv_id) AS conv_id, said, any_value(n_turns) AS n_turns, count(*) AS copies
  FROM chats WHERE said NOT IN (SELECT said FROM starts) GROUP BY said)
SELECT conv_id, (k - 1) // 64 AS part, n_turns, copies,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM kept JOIN turns USING (conv_id) GROUP BY conv_id, (k - 1) // 64, n_turns, copies"""


def _passes(kind: str, value: str) -> str:
    digits = rf"regexp_replace({value}, '[^0-9]', '', 'g')"
    if kind == "ip":
        parts = f"list_transform(string_split({value}, '.'), lambda x: ltrim(x, '0'))"
        return f"len(list_filter({parts}, lambda x: length(x) > 3 OR coalesce(try_cast(x AS INT), 0) > 255)) = 0"
    if kind == "card":
        doubled = f"list_transform(string_split(reverse({digits}), ''), lambda x, i: x::INT * (2 - i % 2))"
        return f"length({digits}) BETWEEN 16 AND 19 AND list_sum(list_transform({doubled}, lambda x: CASE WHEN x > 9 THEN x - 9 ELSE x END)) % 10 = 0"
    return f"length({digits}) BETWEEN 8 AND 15" if kind == "phone" else "true"


def sanitising_sql() -> str:
    """Spans of the rules and of revealing terms; the conditions on terms as in the operator's defaults."""
    kinds = list(enumerate(sanitising.RULES.items()))
    base = " UNION ALL ".join(
        rf"""
  SELECT rn, {place} AS ord, '{kind}' AS kind, m,
         list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT rn, regexp_split_to_array(text, '{rule}') AS gaps, regexp_extract_all(text, '{rule}') AS ms FROM texts),
       unnest(range(1, len(ms) + 1)) AS r(k), unnest([ms[k]]) AS o(m) WHERE {_passes(kind, "m")}"""
        for place, (kind, rule) in kinds
    )
    held = " UNION ALL ".join(
        f"SELECT DISTINCT id, '{kind}:' || m AS entity FROM units, unnest(regexp_extract_all(unit, '{rule}')) AS o(m) WHERE {_passes(kind, 'm')}"
        for _, (kind, rule) in kinds
    )
    bare = "unit"
    for _, (_, rule) in kinds:
        bare = f"regexp_replace({bare}, '{rule}', ' ', 'g')"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    generalised, removed = 1 << sanitising.GENERALISE_BITS, 1 << sanitising.REMOVE_BITS
    return rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
base AS ({base}),
sentences AS (
  SELECT rn, text, k, regexp_extract_all(sentence, '[^\x20\x09-\x0D]+') AS w
  FROM texts, unnest(regexp_split_to_array(text, '{sanitising.UNIT_ENDS}')) WITH ORDINALITY AS o(sentence, k)),
units AS (
  SELECT text, row_number() OVER () AS id, list_aggregate(w[p:p + {sanitising.UNIT_WORDS - 1}], 'string_agg', ' ') AS unit
  FROM sentences, unnest(range(1, len(w) + 1, {sanitising.UNIT_WORDS})) AS r(p)),
unit_terms AS (
  SELECT DISTINCT id, text, term FROM units, unnest(regexp_extract_all({lower.format(bare)}, '{term}')) AS o(term)),
counts AS (SELECT term, count(*) AS n_units FROM unit_terms GROUP BY term),
held AS ({held}),
pairs AS (
  SELECT entity, term, count(*) AS n_both, count(DISTINCT text) AS n_texts FROM held JOIN unit_terms USING (id) GROUP BY entity, term),
revealing AS (
  SELECT DISTINCT term FROM pairs JOIN counts USING (term)
  WHERE n_units <= n_both * {removed} OR (n_units <= n_both * {generalised} AND n_texts >= {sanitising.MIN_TEXTS})),
places AS (
  SELECT rn, m, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT rn, regexp_split_to_array(text, '{term}') AS gaps, regexp_extract_all(text, '{term}') AS ms FROM texts
        WHERE rn IN (SELECT rn FROM base)
           OR len(list_intersect(regexp_extract_all({lower.format("text")}, '{term}'), (SELECT list(term) FROM revealing))) > 0),
       unnest(range(1, len(ms) + 1)) AS r(k), unnest([ms[k]]) AS o(m)
  WHERE {lower.format("m")} IN (SELECT term FROM revealing)),
added AS (
  SELECT rn, {len(kinds)} AS ord, '{sanitising.TERM}' AS kind, m, s FROM places
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rn = places.rn AND base.s < places.s + length(places.m) AND places.s < base.s + length(base.m))),
spans AS (
  SELECT rn, ord, kind, s, kind || ':' || s::BIGINT || ':' || (s + length(m))::BIGINT AS shown FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
digests AS (
  SELECT rn, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for _, (kind, _) in kinds)},
         string_agg(shown, ',' ORDER BY ord, s) FILTER (kind <> '{sanitising.TERM}') AS base, string_agg(shown, ',' ORDER BY ord, s) AS spans
  FROM spans GROUP BY rn)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for _, (kind, _) in kinds)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN digests USING (rn)"""


def importance_sql(buckets: int = 10_000, min_words: int = 20, percent: int = 10) -> str:
    """The CRC is folded byte by byte over the distinct words, with its table built bit by bit."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return rf"""
WITH table_of AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: {step}) ORDER BY b) AS t FROM unnest(range(256)) AS r(b)),
texts AS (SELECT doc_id, row_number() OVER () AS rn, {words} AS w FROM documents),
places AS (SELECT rn, word FROM texts, unnest(w) AS o(word)),
wanted AS (SELECT word FROM benchmark, unnest({words}) AS o(word)),
bytes AS (
  SELECT word, list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT) AS b
  FROM (SELECT word FROM places UNION SELECT word FROM wanted)),
buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {buckets} AS bucket
  FROM bytes, table_of),
s AS (SELECT bucket, count(*) AS n FROM places JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {buckets}) / ((s.n + 1)::DOUBLE * (t_all + {buckets}))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT rn, sum(gain) AS weight FROM places JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY rn),
scored AS (
  SELECT doc_id, rn, len(w) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (rn)),
able AS (
  SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id, rn) AS place, count(*) OVER () AS total FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= {percent} * total // 100 THEN place END AS rank
FROM scored LEFT JOIN able USING (rn)"""


def all_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": EXACT_DEDUP,
        "op4_quality_rules": quality_rules_sql(),
        "op5_chat_format": CHAT_FORMAT,
        "op7_substring_dedup": SUBSTRING_DEDUP,
        "op12_importance": importance_sql(),
        "op13_sanitising": sanitising_sql(),
    }
