import re
from collections import defaultdict

import cases
import pytest
from pyspark.sql import functions as F

from pressgrid.llm import queries, sanitising

RULES = {kind: re.compile(rule) for kind, rule in sanitising.RULES.items()}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passes(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def matches(text):
    return [(kind, m.start(), m.end(), m.group(0)) for kind, rule in RULES.items() for m in rule.finditer(text) if passes(kind, m.group(0))]


def units(text):
    for sentence in re.split(sanitising.UNIT_ENDS, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", sentence)
        for k in range(0, len(words), sanitising.UNIT_WORDS):
            yield " ".join(words[k : k + sanitising.UNIT_WORDS])


def terms(text):
    for rule in RULES.values():
        text = rule.sub(" ", text)
    return set(TERM.findall(text.translate(UPPER)))


def revealing(texts, min_texts=2, generalise_bits=1, remove_bits=0):
    """term -> removed, by plain counting."""
    n_units, both, seen = defaultdict(int), defaultdict(int), defaultdict(set)
    for text in texts:
        for unit in units(text or ""):
            own = terms(unit)
            for t in own:
                n_units[t] += 1
                for entity in {(kind, value) for kind, _, _, value in matches(unit)}:
                    both[entity, t] += 1
                    seen[entity, t].add(text)
    found = {}
    for (entity, t), n in both.items():
        removed = n_units[t] <= n * 2**remove_bits
        if removed or (n_units[t] <= n * 2**generalise_bits and len(seen[entity, t]) >= min_texts):
            found[t] = found.get(t, False) or removed
    return found


def brute(rows, **limits):
    judged = revealing([t for _, t in rows], **limits)
    out = []
    for i, t in rows:
        base = [m[:3] for m in matches(t or "")]
        more = [("term", m.start(), m.end()) for m in TERM.finditer(t or "") if m.group(0).translate(UPPER) in judged]
        out.append((i, base, base + [m for m in more if not any(s < m[2] and m[1] < e for _, s, e in base)]))
    return sorted(out, key=repr)


def collected(frame):
    rows = frame.collect()
    return sorted(((r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in rows), key=repr)


TEXTS = [
    "Mail jane.roe+x@mail.example.com, or call +1 (017) 555-7713 now. Nothing here.",
    "a@b.c+d@e.f a@b@c.d @x.y x@y z%z@q-q.r-r.t",
    "1.2.3.4.5.6.7.8 1.2.3 300.1.1.1 001.0002.3.255 9.9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12345678901234567890123 4 5 6",
    "+49 (30) 123 +1 +12 +123456789012345 +1234567890123456 +1-2-3-4-5-6-7-8 end",
    "été 日本語 𝄞 jane@mail.example.com 𝄞 ünder 4111111111111111 Ärger",
    "Quill meets jane@mail.example.com. Quill writes to jane@mail.example.com! Quill Quill",
    "Again Quill with jane@mail.example.com of 42 Plainville.\nplainville is far away",
    "Common words near 10.0.0.1 and common words near 10.0.0.1, " + "common words. " * 40,
    "Common words near 10.0.0.1 and Zed.",
    "trailing dot a@b.c. next+1 (017) 555-7713",
]


@pytest.mark.parametrize("limits", [{}, {"min_texts": 1, "generalise_bits": 2, "remove_bits": 1}, {"min_texts": 99, "generalise_bits": 0}])
def test_against_plain_counting(spark, limits):
    rows = [(100 + k, t, "en", "s") for k, t in enumerate(TEXTS)] + cases.AWKWARD
    rows += [(200, TEXTS[0], None, None), (200, TEXTS[0], None, None), (None, TEXTS[6], "en", "s")]
    got = collected(sanitising.sanitise(cases.frame(spark, rows), **limits))
    assert got == brute([(i, t) for i, t, _, _ in rows], **limits)
    assert collected(sanitising.sanitise(cases.empty(spark), **limits)) == []


def test_long_runs_take_one_pass(spark):
    long = ["a" * 300_000, "1" * 20_000, "1 " * 20_000, "9." * 20_000, "a@" + "b.c" * 20_000, "+1" + " " * 20_000, "x@y.z " * 3000]
    rows = [(k, t, "en", "s") for k, t in enumerate(long)]
    found = sanitising.sanitise(cases.frame(spark, rows)).select("doc_id", "base").collect()
    for r in found:
        text = long[r.doc_id]
        if r.doc_id == 0:
            assert r.base == []  # the plain rule alone would take the square of its length
        else:
            assert [tuple(s) for s in r.base] == [m[:3] for m in matches(text)]


def test_sanitised_texts(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(TEXTS)]
    shown = {r.doc_id: r.sanitised for r in sanitising.sanitise(cases.frame(spark, rows)).collect()}
    assert shown[6] == "[NAME]  [EMAIL]. [NAME]   [EMAIL]! [NAME] [NAME]"  # the removed words stand by the entity alone
    assert shown[9] == "Common words  [IP]  ."  # the words between occur by this address alone
    assert shown[7].endswith(" is far away")
    assert all(e not in shown[k] for k, t in enumerate(TEXTS) for _, _, _, e in matches(t) if k != 4)  # 4 holds one inside a longer number


def test_texts_without_entities_stay(spark):
    folder = "/root/testdata/sf0.01"
    rows = queries.op13_sanitising(spark, folder).collect()
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    wanted = {i: (base, spans) for i, base, spans in brute(documents)}
    for r in rows:
        base, spans = wanted[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == kind for s in base) for kind in sanitising.KINDS)
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert base or not spans
    assert any("term" in r.spans for r in rows)


def test_luhn(spark):
    numbers = ["4111111111111111", "4111111111111112", "6011000990139424", "123", "41111111111111111"]
    frame = spark.createDataFrame([(n,) for n in numbers], "n string")
    assert [r[0] for r in frame.select(sanitising.passes("card", F.col("n"))).collect()] == [passes("card", n) for n in numbers]
