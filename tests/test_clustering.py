"""Set-wise clustering against a one-article-at-a-time model."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pressgrid.operators import clustering, embedding

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
SCHEMA = "article_id long, published_at timestamp, embedding array<float>, story_id long"


def one_by_one(rows, lookback, threshold):
    """Article -> (story, is_new, parent), taking the batch in order like a cron job would."""
    cut = NOW - timedelta(days=lookback)
    unit = {r[0]: np.array(r[2], float) / max(np.linalg.norm(np.array(r[2], float)), 1e-30) for r in rows}
    placed = sorted((r for r in rows if r[3] is not None), key=lambda r: (r[1], r[0]))
    story = {r[0]: (r[3], False) for r in placed}
    out = {}
    for r in sorted((r for r in rows if r[3] is None), key=lambda r: (r[1], r[0])):
        best = None
        for position, p in enumerate(placed):
            if p[1] >= cut and np.any(unit[p[0]]) and np.any(unit[r[0]]):
                sim = round(float(unit[p[0]] @ unit[r[0]]), 6)
                if best is None or sim > best[0]:
                    best = (sim, p[0])
        if best and best[0] >= threshold:
            story[r[0]] = story[best[1]]
            out[r[0]] = (*story[r[0]], best[1])
        else:
            story[r[0]] = (r[0], True)
            out[r[0]] = (r[0], True, None)
        placed.append(r)
    return out


def case(seed, n=60, dim=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows, pool = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35 and pool:  # exact copy; one vector becomes very frequent
            vector = pool[0] if rng.random() < 0.7 else rng.choice(pool)
        elif kind < 0.4:
            vector = [0.0] * dim
        elif kind < 0.55:  # short support
            vector = [0.0] * dim
            vector[rng.randrange(dim)] = 1.0
        else:
            vector = [c + rng.gauss(0, 0.5) for c in rng.choice(centres)]
        vector = [float(np.float32(x)) for x in vector]
        pool.append(vector)
        at = NOW - timedelta(hours=rng.randrange(0, 24 * 6), minutes=rng.choice([0, 0, 30]))
        rows.append((i + 1, at, vector, 900 + rng.randrange(3) if rng.random() < 0.2 else None))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_matches_the_sequential_model(spark, seed):
    rows = case(seed)
    expected = one_by_one(rows, 3, 0.75)
    df = spark.createDataFrame(rows, SCHEMA)
    # Tiny cells and blocks, so that one question is answered by many block pairs.
    got = clustering.assign_stories(df, F.lit(NOW), 3, 0.75, block_rows=7, cell_rows=(9, 60)[seed % 2]).collect()
    assert {r.article_id: (r.story_id, r.is_new_story, r.parent_id) for r in got} == expected


def groups_of(spark, rows, threshold=0.75):
    members = clustering._members(spark.createDataFrame(rows, SCHEMA), F.lit(NOW), 3)
    return clustering._groups(members)


def tight(seed, clusters, each, dim=24, spread=0.05):
    """Batch rows in tight clusters around random directions."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    out = []
    for i in range(clusters * each):
        v = centres[i % clusters] + spread * rng.standard_normal(dim)
        out.append((i + 1, NOW - timedelta(minutes=int(rng.integers(0, 4000))), [float(np.float32(x)) for x in v], None))
    return out


def sparse(seed, topics, each, dim=64):
    """Batch rows with a few components each, on the dimensions of their topic."""
    rng = random.Random(seed)
    homes = [rng.sample(range(dim), 4) for _ in range(topics)]
    out = []
    for i in range(topics * each):
        v = [0.0] * dim
        for d in rng.sample(homes[i % topics], 3):
            v[d] = rng.choice([1.0, 2.0, -1.0])
        out.append((i + 1, NOW - timedelta(minutes=rng.randrange(4000)), v, None))
    return out


@pytest.mark.parametrize("make", [tight, sparse])
def test_bounds_skip_most_cells_and_lose_no_partner(spark, make):
    rows = make(3, 12, 25)
    expected = one_by_one(rows, 3, 0.75)
    got = clustering.assign_stories(spark.createDataFrame(rows, SCHEMA), F.lit(NOW), 3, 0.75, block_rows=50, cell_rows=10).collect()
    assert {r.article_id: (r.story_id, r.is_new_story, r.parent_id) for r in got} == expected

    groups = groups_of(spark, rows)
    candidates, cells = clustering.plan_cells(groups, 0.75, cell_rows=10)
    n = candidates.count()
    assert cells.rows.sum() == n and len(cells.rows) <= clustering.MAX_PIVOTS * (clustering.MAX_SLICES + 1)
    met = clustering.with_reached(clustering._flat(groups.where("asks")), cells, 0.75).select(F.explode("cells").alias("c")).collect()
    compared = sum(int(cells.rows[r.c]) for r in met)
    assert compared < 0.25 * n * n  # of all query-candidate pairs; the order alone would leave about a half


def test_pairs_grow_slower_than_the_square(spark):
    def compared(clusters):
        groups = groups_of(spark, tight(4, clusters, 25))
        _, cells = clustering.plan_cells(groups, 0.75, cell_rows=10)
        met = clustering.with_reached(clustering._flat(groups.where("asks")), cells, 0.75).select(F.explode("cells").alias("c")).collect()
        return sum(int(cells.rows[r.c]) for r in met)

    assert compared(32) < 4 * 0.75 * compared(16)


def test_slices_follow_the_order():
    at = np.array([5, 10, 11, 30, 0])
    assert clustering.order_slice(np.array([1, 1, 1, 1, 0]), at, [10, 20]).tolist() == [1, 2, 2, 3, 0]
    assert clustering.order_slice(np.array([-1, 1]), np.array([0, 3]), []).tolist() == [0, 1]


def test_long_chain_settles_on_its_root(spark):
    # Each vector is similar only to its neighbours; the chain needs several jumps.
    angle = np.deg2rad(30)
    rows = [(i, NOW - timedelta(hours=40 - i), [float(np.cos(i * angle / 2)), float(np.sin(i * angle / 2))], None) for i in range(12)]
    expected = one_by_one(rows, 3, 0.96)
    got = clustering.assign_stories(spark.createDataFrame(rows, SCHEMA), F.lit(NOW), 3, 0.96).collect()
    assert {r.article_id: (r.story_id, r.is_new_story, r.parent_id) for r in got} == expected
    assert {r.story_id for r in got} == {0}


def test_threshold_is_inclusive_and_old_articles_attach_but_do_not_attract(spark):
    old = NOW - timedelta(days=5)
    rows = [
        (1, old, [1.0, 0.0], None),                        # old: starts a story
        (2, NOW - timedelta(hours=5), [1.0, 0.0], None),   # same vector, but 1 is too old to attract it
        (3, NOW - timedelta(hours=4), [0.6, 0.8], None),   # similarity 0.6 to 2
        (4, old, [0.6, 0.8], None),
    ]
    got = {r.article_id: r.story_id for r in clustering.assign_stories(spark.createDataFrame(rows, SCHEMA), F.lit(NOW), 3, 0.6).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4}


def test_hash_embedding_layout(spark):
    import hashlib

    text = "Budget vote budget\n\nsenate É 123"
    vector = np.zeros(384)
    for token in text.lower().split():
        digest = hashlib.md5(token.encode()).digest()
        vector[int.from_bytes(digest[:4], "little") % 384] += 1 if digest[4] % 2 else -1
    vector /= np.linalg.norm(vector)
    rows = embedding.hash_embedding(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), "t").orderBy("id").collect()
    assert np.allclose(rows[0].embedding, vector, atol=1e-7)
    assert not any(rows[1].embedding) and not any(rows[2].embedding)


def test_rollup(spark):
    rows = [(1, NOW, "late", 7), (2, NOW - timedelta(days=1), "first", 7), (3, NOW, "x" * 600, 8)]
    got = {r.story_id: r for r in clustering.story_rollup(
        spark.createDataFrame(rows, "article_id long, published_at timestamp, headline string, story_id long")).collect()}
    assert (got[7].article_count, got[7].title) == (2, "first") and len(got[8].title) == 500


@pytest.mark.parametrize("make", [tight, sparse])
def test_vectors_travel_by_block_not_by_cell(spark, make):
    rows = make(5, 12, 25)
    groups = groups_of(spark, rows)
    candidates, cells = clustering.plan_cells(groups, 0.0, cell_rows=5)
    blocks = clustering.plan_blocks(cells, block_rows=100)
    # Nothing is skipped at threshold 0: by cell, each query would travel some 60 times.
    assert (cells.rows > 0).sum() > 20 and len(blocks.cells) <= 8
    sent = clustering.deal(clustering._flat(groups.where("asks")), candidates, cells, blocks, 3, 0.0)
    n = candidates.count()
    assert sent.where("kind = 0").count() == 3 * n and n < sent.where("kind = 1").count() <= len(blocks.cells) * n
    held = [set(b.tolist()) for b in blocks.cells]
    assert set().union(*held) == set(np.flatnonzero(cells.rows).tolist())


def test_nearly_equal_partners_are_told_apart(spark):
    # Similarities differ by less than single precision shows; the earlier of equal ones wins.
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [(i, NOW - timedelta(minutes=900 - i), [float(np.float32(x)) for x in centre + 1e-4 * rng.standard_normal(16)], None) for i in range(400)]
    expected = one_by_one(rows, 3, 0.75)
    got = clustering.assign_stories(spark.createDataFrame(rows, SCHEMA), F.lit(NOW), 3, 0.75, block_rows=90, cell_rows=30).collect()
    assert {r.article_id: (r.story_id, r.is_new_story, r.parent_id) for r in got} == expected


def test_few_whole_vectors_are_compared_and_no_partner_is_lost(monkeypatch):
    # Topics of unequal spread, so that tiles differ in what the axes leave out; some vectors are multiples of others.
    rng = np.random.default_rng(11)
    n, dim, threshold = 3000, 64, 0.75
    topics = rng.standard_normal((6, dim))
    cell = rng.integers(0, 6, n).astype(np.int32)
    vectors = topics[cell] + rng.uniform(0.5, 4, (n, 1)) * rng.standard_normal((n, dim)) * 0.85 ** np.arange(dim)
    vectors[n // 2 :: 7] = 2 * vectors[: len(vectors[n // 2 :: 7])]
    vectors = vectors.astype(np.float32)
    in_batch, at = (rng.random(n) < 0.7).astype(np.int32), rng.integers(0, 500, n)

    def rows(some, kind, wants):
        return pa.RecordBatch.from_pydict({
            "pair": np.zeros(len(some), np.int32), "kind": np.full(len(some), kind, np.int32), "cell": cell[some], "met": [b"\xfc"] * len(some),
            "h1": some, "h2": some, "embedding": pa.FixedSizeListArray.from_arrays(pa.array(vectors[some].ravel()), dim).cast(pa.list_(pa.float32())),
            "wants": wants, "in_batch": in_batch[some], "at": at[some], "article_id": some, "story_id": some,
        })

    compared, meet = [], clustering._Best.compare
    monkeypatch.setattr(clustering._Best, "compare", lambda self, asked, tile: compared.append(len(asked)) or meet(self, asked, tile))
    every, asks = np.arange(n), np.flatnonzero(in_batch)
    wants = np.where(asks % 5 == 0, 3, 1).astype(np.int32)
    blocks = clustering.Blocks(np.zeros(6, int), np.ones(6, int), [np.arange(6)])
    got = pa.Table.from_batches(clustering._block_best(blocks, 1, threshold)(iter([rows(every, 0, np.zeros(n, np.int32)), rows(asks, 1, wants)])))

    unit = vectors.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    order = np.lexsort((every, at, in_batch))
    place = np.argsort(order)
    sims = np.round(unit @ unit[order].T, 6)
    expected = set()
    for q, w in zip(asks.tolist(), wants.tolist()):
        for kind, limit in ((clustering.EARLIER, place[q]), (clustering.EXISTING, int((in_batch == 0).sum()))):
            if w >> kind & 1 and limit and sims[q, :limit].max() >= threshold:
                expected.add((q, kind, int(order[sims[q, :limit].argmax()])))
    assert set(zip(*(got.column(c).to_pylist() for c in ("h1", "kind", "article_id")))) == expected and len(expected) > 1000
    assert sum(compared) * clustering.TILE_ROWS < 0.6 * len(asks) * n  # the order alone leaves nearly all tiles here


def test_only_articles_that_are_no_candidates_ask_for_clustered_ones_alone(spark):
    old = NOW - timedelta(days=5)
    rows = [
        (1, NOW, [1.0, 0.0], None), (2, old, [0.0, 1.0], None), (3, NOW, [1.0, 1.0], None), (4, old, [1.0, 1.0], None), (5, None, [2.0, 1.0], None),
        (6, NOW, [3.0, 1.0], 7),
    ]
    wants = {tuple(r.embedding): r.wants for r in groups_of(spark, rows).collect()}
    earlier, existing = 1 << clustering.EARLIER, 1 << clustering.EXISTING
    assert wants == {(1.0, 0.0): earlier, (0.0, 1.0): existing, (1.0, 1.0): earlier + existing, (2.0, 1.0): earlier, (3.0, 1.0): 0}
