import random

import pytest

import cases
from pressgrid.llm import substring_dedup


def brute(rows, window):
    """(words, kept words) per row."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in rows:
        w = cases.words(text)
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            first[run] = min(first.get(run, float("inf")), key(i))
    out = []
    for i, text in rows:
        w = cases.words(text)
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < key(i) for j in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def result(spark, rows, window=13):
    found = substring_dedup.substring_dedup(cases.frame(spark, rows), window).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, " ".join(cases.words(r.text))) for r in found), key=repr)


def test_levels():
    assert substring_dedup.levels(13) == [7, 13]
    assert substring_dedup.levels(50) == [7, 13, 25, 50]


def test_awkward(spark):
    assert result(spark, cases.AWKWARD) == brute([r[:2] for r in cases.AWKWARD], 13)
    kept = substring_dedup.substring_dedup(cases.frame(spark, cases.AWKWARD))
    assert kept.columns == [*cases.frame(spark, []).columns, "n_words", "n_removed"]
    by_id = {r.doc_id: r for r in kept.where("doc_id not in (2)").collect()}
    assert by_id[6].text == "   \n\t " and by_id[4].text is None and by_id[9].text == "lead in and out\nlast line"
    assert substring_dedup.substring_dedup(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("seed, window", [(1, 13), (2, 13), (3, 50), (4, 27)])
def test_against_brute_force(spark, seed, window):
    rng = random.Random(seed)
    rows = [(i, t, "en", "s") for i, t in cases.near_texts(seed, 12, 5, 50, 2, 60)]
    rows += [(rng.choice([3, 5, None]), rows[k][1][: rng.randint(20, 400)], "en", "s") for k in range(10)]  # ids that repeat
    assert result(spark, rows, window) == brute([r[:2] for r in rows], window)
