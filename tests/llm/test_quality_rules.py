from collections import Counter

import cases
from pressgrid.llm import quality_rules


def brute(text):
    words = cases.words(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if cases.words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base_rule(spark):
    rows = quality_rules.quality_rules(cases.frame(spark, cases.AWKWARD)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t, _, _ in cases.AWKWARD), key=repr)
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(cases.empty(spark)).count() == 0


def test_limits_follow_the_group(spark):
    clean = [(i, f"{cases.BASE} and {i} more words", "en", "plain") for i in range(600)]
    marked = [(1000 + i, " ".join(f"{w}#" for w in f"{cases.BASE} and {i} more words".split()), "en", "marked") for i in range(400)]
    odd = [(5000, marked[0][1], "en", "plain")]
    rows = {r.doc_id: r.kept for r in quality_rules.quality_rules(cases.frame(spark, clean + marked + odd), prior_rows=1).collect()}
    assert all(kept for i, kept in rows.items() if i < 5000)
    assert not rows[5000]


def test_limits_blend_without_a_switch(spark):
    """A group's limit moves from its language's towards its own with every row, and its spread widens it."""
    sketch = [("en", "big", "symbol_rate", 0, 99900), ("en", "big", "symbol_rate", 40, 100)]
    seen = []
    for n in (1, 10, 49, 50, 51, 200, 2000):
        small = [("en", "small", "symbol_rate", 10, n), ("en", "small", "symbol_rate", 30, n)]
        frame = spark.createDataFrame(sketch + small, "lang string, source string, rate string, bucket long, n long")
        seen.append({r.source: r.upper for r in quality_rules.blended_limits(frame, 200).collect()}["small"])
    own = 30 + 2 * (30 - 10) + 20
    assert seen == sorted(seen) and seen[0] == 20 < seen[1] < seen[2] < seen[5] and 0 <= own - seen[-1] <= 6
    assert seen[4] - seen[2] <= 1


def test_null_groups_and_ties_against_brute_force(spark):
    texts = [f"{cases.BASE} and {i} more words" + "#" * (40 if i == 39 else i % 7) for i in range(40)]
    rows = [(i, t, (None, "en", "de")[i % 3], (None, "a")[i % 2]) for i, t in enumerate(texts)] * 2
    got = quality_rules.quality_rules(cases.frame(spark, rows)).collect()
    assert len(got) == 80

    def limit(values, floor):
        ranked = sorted(v if v < 64 else v >> (v.bit_length() - 6) << (v.bit_length() - 6) for v in values)
        at = lambda share: ranked[-(-share * len(ranked) // 100) - 1]
        return at(90) + 2 * (at(90) - at(50)) + floor

    def rates(text):
        n, chars, symbols, lines, repeats = brute(text)
        return symbols * 1000 // n, repeats * 1000 // n, lines * 1000 // n, chars * 100 // n

    whole = {}
    for k, floor in enumerate((20, 100, 20, 50)):
        top = limit([rates(t)[k] for _, t, _, _ in rows], floor)
        for lang in (None, "en", "de"):
            of_lang = [rates(t)[k] for _, t, x, _ in rows if x == lang]
            above = (len(of_lang) * limit(of_lang, floor) + 200 * top) // (len(of_lang) + 200)
            for source in (None, "a"):
                own = [rates(t)[k] for _, t, x, y in rows if (x, y) == (lang, source)]
                whole[k, lang, source] = (len(own) * limit(own, floor) + 200 * above) // (len(own) + 200)
    want = {i: all(rates(t)[k] <= whole[k, lang, source] for k in range(4)) for i, t, lang, source in rows}
    assert {r.doc_id: r.kept for r in got} == want and set(want.values()) == {True, False}


def test_sketches_merge(spark):
    counts = quality_rules.base_counts(cases.frame(spark, cases.AWKWARD)).cache()
    whole = quality_rules.rate_sketches(counts)
    parts = quality_rules.rate_sketches(counts.where("doc_id % 2 = 0")).unionByName(quality_rules.rate_sketches(counts.where("not (doc_id % 2 <=> 0)")))
    limits = [sorted(map(tuple, quality_rules.sketch_limits(x, ["lang", "source"]).collect()), key=repr) for x in (whole, parts)]
    assert limits[0] == limits[1]
