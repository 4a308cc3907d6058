import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from pressgrid.llm import graph, jaccard_join


def sets_of(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, text in rows:
        w = cases.words((text or "").translate(lower))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    return out


def brute(rows):
    sets = sets_of(rows)
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = cases.union(links, sets)
    return {(i, len(sets[i]), roots[i]) for i in sets}


def result(spark, rows):
    found = jaccard_join.jaccard_components(cases.frame(spark, [(*r, "en", "s") for r in rows])).collect()
    assert len(found) == len(rows)
    return {tuple(r) for r in found}


# Three edits in sixty words sit at the border of 0.8: chains form whose ends don't link.
@pytest.mark.parametrize("seed, edits", [(1, 2), (2, 3), (3, 4), (4, 6)])
def test_against_brute_force(spark, seed, edits):
    rows = cases.near_texts(seed, 8, 14, 60, edits)
    rows += [(1000 + k, rows[k][1]) for k in range(20)] + [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  B"), (2004, "b a")]
    assert result(spark, rows) == brute(rows)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "CELL_SHINGLES", 150)
    rows = cases.near_texts(7, 6, 14, 60, 4)
    assert result(spark, rows) == brute(rows)


def test_awkward(spark):
    rows = [r for r in cases.AWKWARD if r[0] is not None]
    found = {tuple(r) for r in jaccard_join.jaccard_components(cases.frame(spark, cases.AWKWARD)).where("doc_id is not null").collect()}
    assert found == brute([r[:2] for r in rows])
    nulls = jaccard_join.jaccard_components(cases.frame(spark, cases.AWKWARD)).where("doc_id is null").collect()
    assert sorted((r.component_id is None, r.component_id or 0) for r in nulls) == [(False, 1), (True, 0)]
    assert jaccard_join.jaccard_components(cases.empty(spark)).count() == 0
    kept = jaccard_join.one_of_each(cases.frame(spark, [r for r in cases.AWKWARD if r[0] != 2]))
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, -1, 1, 4, 5, 6, 7, 9, 10, 11, 12]  # 8 links with 1


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    for n in (1, 2, 9, 70, 300):
        base = [rng.choice(10**6, rng.integers(1, 150), replace=False) for _ in range(max(1, n // 4))]
        sets = [set(b[rng.random(len(b)) > 0.05].tolist()) | {int(rng.integers(10**6))} for b in (base[rng.integers(len(base))] for _ in range(n))]
        rows = np.concatenate([np.full(len(s), k) for k, s in enumerate(sets)])
        maps = jaccard_join.bitmaps(rows, np.concatenate([jaccard_join.W.mix(np.array(sorted(s), np.uint64)) for s in sets]), n)
        size, root = np.array([len(s) for s in sets]), rng.integers(0, max(1, n // 2), n)
        at = np.argsort(size, kind="stable")
        i, j = jaccard_join.tree_pairs(jaccard_join.Level(maps[at], maps[at], size[at], size[at], root[at]), 80)
        got = {tuple(sorted((int(at[a]), int(at[b])))) for a, b in zip(i, j)}
        assert len(got) == len(i)
        assert {
            (a, b) for a, b in combinations(range(n), 2) if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        } <= got


@pytest.mark.parametrize(
    "links", [[], [(k, k + 1) for k in range(40)], [(k + 1, k) for k in range(0, 40, 2)] + [(5, 7), (3, 3)], [(0, k) for k in range(1, 50)], [(k * 7 % 61, k * k % 61) for k in range(50)]]
)
def test_components(spark, links):
    found = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    real = [(a, b) for a, b in links if a != b]
    assert {r.node: r.root for r in found} == cases.union(real, {x for link in real for x in link})
    assert len(found) == len({r.node for r in found})


def test_first_shingles_are_whole_sets_of_short_texts(spark):
    found = jaccard_join.first_shingles(spark.createDataFrame([("a b c d e f",), ("a",), (None,)], "text string"), np.empty(0, np.uint64), 5, 80)
    assert found.groupBy("node").agg(F.count("*").alias("n")).count() == 2


def test_long_texts_that_share_a_passage_are_not_verified_and_tables_end_early(spark, monkeypatch):
    """Their bitmaps are full and rule nothing out; too few first shingles in common do."""
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(600)]
    rows = [(k, " ".join([f"{k}w{rng.randrange(10**6)}" for _ in range(2400)] + passage)) for k in range(8)]
    rows += [(10 + k, text.replace("p7 ", "q7 ")) for k, text in rows[:2]]
    stash, seen, alive = jaccard_join.stash, {}, {}

    def noted(frame, name):
        table = stash(frame, name)
        seen.setdefault(name, []).append((table.stash_folder, table.count()))
        alive[name] = {n for n, found in seen.items() if any(os.path.exists(folder.removeprefix("file:")) for folder, _ in found)}
        return table

    monkeypatch.setattr(jaccard_join, "HEAVY", 0)  # in a small table every shared shingle would count as frequent
    monkeypatch.setattr(jaccard_join, "stash", noted)
    assert result(spark, rows) == brute(rows)
    assert sum(count for _, count in seen["node-pairs"]) == 0
    assert not alive["mixed"] & {"first-shingles", "leads", "members"} and not alive["node-pairs"] & {"mixed", "placed", "bucket-roots"}


def test_pairs_of_a_cell_are_held_in_parts():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(3)]
    texts += [texts[0] + " end", "short"]
    pack = jaccard_join.zstandard.ZstdCompressor(level=1).compress
    held = jaccard_join.CellTexts(5)
    for low, high in ((0, 2), (2, 5)):
        held.add(np.array([50, 40, 30, 20, 10])[low:high], jaccard_join.pa.array([pack(t.encode()) for t in texts[low:high]]))
    assert held.linked(np.array([50, 50, 40]), np.array([20, 30, 10]), 80).tolist() == [True, False, False]
    assert held.linked(np.array([20]), np.array([50]), 80).tolist() == [True]


def test_a_pair_leaves_one_bucket_and_only_with_enough_in_common():
    """Leaves know their first buckets only; whatever they have in common, a pair passes, in one bucket if they know it."""
    rng = np.random.default_rng(2)
    for buckets in (30, 200):
        own = [np.sort(rng.choice(buckets, rng.integers(1, 30), replace=False)) for _ in range(40)]
        carried = np.array([np.append(x[: jaccard_join.CARRIED], [jaccard_join.LAST] * (jaccard_join.CARRIED - len(x))) for x in own])
        left = {}
        for bucket in range(buckets):
            i, j = (np.array(x, np.int64) for x in zip(*combinations(range(40), 2)))
            fit = np.array([bucket in own[a] and bucket in own[b] for a, b in zip(i, j)])
            i, j = i[fit], j[fit]
            for pair in zip(*(x[~jaccard_join.met_before(carried, i, j, bucket)].tolist() for x in (i, j))):
                left[pair] = left.get(pair, 0) + 1
        common = {(a, b): len(np.intersect1d(own[a], own[b])) for a, b in combinations(range(40), 2)}
        assert set(left) == {pair for pair, n in common.items() if n}
        assert all(n == 1 for (a, b), n in left.items() if len(own[a]) <= jaccard_join.CARRIED and len(own[b]) <= jaccard_join.CARRIED)
        assert sum(left.values()) < sum(common.values())

        m, n = np.array([len(x) for x in own]), rng.integers(60, 100, 40)
        maps = jaccard_join.bitmaps(np.repeat(np.arange(40), m), jaccard_join.W.mix(np.concatenate(own).astype(np.uint64)), 40)
        i, j = (np.array(x) for x in zip(*common))
        needed = (80 * (n[i] + n[j]) + 179) // 180 - (80 * np.maximum(n[i], n[j]) + 99) // 100 + 1
        allowed = jaccard_join.may_share(m, maps, n, i, j, 80)
        assert allowed[np.array(list(common.values())) >= needed].all() and not allowed.all()


def test_other_leaders_join_a_group_of_near_copies_before_pairs_are_listed(spark, monkeypatch):
    """Each of 60 copies of a text has a run of edits of its own: those link whose runs lie near, so no copy links with all."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(60):
        own = list(base)
        begin = rng.randrange(40, 72)
        own[begin : begin + 5] = [f"x{rng.randrange(10**6)}" for _ in range(5)]
        rows.append((k, " ".join(own)))
    sets = sets_of(rows)
    links = sum(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in combinations(sets, 2))
    stash, counts = jaccard_join.stash, {}

    def noted(frame, name):
        table = stash(frame, name)
        counts[name] = table.count()
        return table

    monkeypatch.setattr(jaccard_join, "HEAVY", 0)
    monkeypatch.setattr(jaccard_join, "stash", noted)
    assert result(spark, rows) == brute(rows)
    assert links > 200 and counts.get("node-pairs", 0) < links / 2
