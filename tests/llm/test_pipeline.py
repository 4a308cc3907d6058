import re

import cases
import corpus_pipeline
from pressgrid.llm.store import stash

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = rows_of(docs)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, DATA), name)
        if name == "packing":
            break
        assert docs.columns == COLUMNS
        seen[name] = rows_of(docs)
    good = seen["quality_classifier"]
    assert good.items() <= before.items() and len(good) > 0.7 * len(before)

    first = {}
    for i in sorted(good):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", good[i]), i)
    assert seen["exact_dedup"] == {i: good[i] for i in first.values()}

    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in seen["exact_dedup"].items():
        w = cases.words(text.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = cases.union(links, ids)
    assert seen["jaccard_join"] == {i: seen["exact_dedup"][i] for i in ids if roots[i] == i}

    start = {}
    for i, text in seen["jaccard_join"].items():
        w = cases.words(text)
        for k in range(len(w) - 12):
            run = tuple(w[k : k + 13])
            start[run] = min(start.get(run, i), i)
    for i, text in seen["jaccard_join"].items():
        w = cases.words(text)
        gone = {k + j for k in range(len(w) - 12) if start[tuple(w[k : k + 13])] < i for j in range(13)}
        left = seen["substring_dedup"][i]
        assert cases.words(left) == [x for k, x in enumerate(w) if k not in gone]
        assert gone or left == text

    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == set(seen["substring_dedup"])
    total = {p.doc_id: p.doc_tokens for p in pieces}
    assert all(sum(p.length for p in pieces if p.doc_id == i) == n for i, n in list(total.items())[:20])


def test_stages_stand_awkward_rows(spark):
    docs = cases.frame(spark, cases.AWKWARD)
    for given in (docs, cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            out = stage(spark, given, DATA)
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            assert bool(rows) == (given is docs)


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "jaccard_join", "substring_dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
