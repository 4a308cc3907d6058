import math

import numpy as np
import pytest

from pressgrid.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component int, whitened string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 7, 3, "x") for i, v in vectors], SCHEMA)


def brute(vectors, components=32):
    """x, whole sums, eigenvalues in falling order and eigenvectors by a library's eigensolver."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    centred = (x - x.min(axis=0)) - (x - x.min(axis=0)).mean(axis=0)
    values, directions = np.linalg.eigh(centred.T @ centred / len(x))
    return x, centred, values[::-1][:components], directions[:, ::-1][:, :components]


def compare(rows, ids, vectors, places=1e-7):
    x, centred, values, directions = brute(vectors)
    n, sums = len(x), x.sum(axis=0)
    exact = {i: sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) for i, row in zip(ids, x)}
    total = np.trace(centred.T @ centred) / n
    got = np.zeros((n, len(values)))
    place = {i: k for k, i in enumerate(ids)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == exact[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / total, rel=1e-8, abs=1e-12)
        assert r.identity_error <= 1e-4
    for k, value in enumerate(values):
        if value > 1e-9 * values[0]:
            wanted = centred @ directions[:, k] / math.sqrt(value)
            assert min(abs(got[:, k] - wanted).max(), abs(got[:, k] + wanted).max()) < places
        else:
            assert not got[:, k].any()
    return got


def test_whole_table_against_an_eigensolver(spark):
    rows = queries.op11_whitening(spark, "/root/testdata/sf0.01").collect()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    assert len(rows) == len(table) * 32
    got = compare(rows, [r.vec_id for r in table], [r.embedding for r in table])
    assert abs(got.T @ got / len(got) - np.eye(32)).max() < 1e-10


def test_small_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.standard_normal(5)]) for i in range(40)]
    good += [(100 + i, list(v)) for i, (_, v) in enumerate(good[:7])]  # copies
    odd = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [1.0, float("nan"), 2.0, 3.0, 4.0]), (203, []), (204, [1.0, 2.0])]
    odd += [(205, [float("inf")] * 5)]
    rows = whitening.whitened_embeddings(frame(spark, good + odd)).collect()
    assert {r.vec_id for r in rows} == {i for i, _ in good}
    assert {r.component for r in rows} == {1, 2, 3, 4, 5}
    compare(rows, [i for i, _ in good], [v for _, v in good])


def test_no_variance_ties_and_no_rows(spark):
    assert whitening.whitened_embeddings(frame(spark, [])).collect() == []
    same = whitening.whitened_embeddings(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(same) == 6 and all(r.whitened == 0 and r.explained == 0 and r.deviation == 0 and r.identity_error == 0 for r in same)
    rng = np.random.default_rng(6)
    flat = [(i, [float(a), 1.0, float(a), float(b)]) for i, (a, b) in enumerate(rng.standard_normal((50, 2)))]  # rank two
    compare(whitening.whitened_embeddings(frame(spark, flat)).collect(), [i for i, _ in flat], [v for _, v in flat])
    cross = [(2 * k + s, [float(((-1) ** s) * (j == k)) for j in range(6)]) for k in range(6) for s in range(2)]  # equal eigenvalues
    rows = whitening.whitened_embeddings(frame(spark, cross)).collect()
    got = np.zeros((12, 6))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
    assert abs(got.T @ got / 12 - np.eye(6)).max() < 1e-10 and all(r.explained == pytest.approx(1 / 6) for r in rows)


def test_directions_against_singular_values():
    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    for square in (
        rng.standard_normal((24, 24)),
        rng.standard_normal((24, 24)) * np.logspace(0, -6, 24),
        rng.standard_normal((24, 3)) @ rng.standard_normal((3, 24)),
        turn * np.repeat([3.0, 2.0, 1.0, 0.5], 6),
        np.eye(24),
        np.zeros((24, 24)),
    ):
        values, vectors = whitening.directions(np.linalg.qr(square, mode="r"))
        assert abs(np.sqrt(values) - np.linalg.svd(square, compute_uv=False)).max() <= 1e-13 * max(1.0, np.linalg.norm(square))
        assert abs(vectors.T @ vectors - np.eye(24)).max() < 1e-13
        assert abs(square.T @ (square @ vectors) - vectors * values).max() <= 1e-13 * max(1.0, np.linalg.norm(square) ** 2)
