"""Whitening of embeddings from the singular values of their centred rows.

Entries become whole numbers, so counts and sums are exact in any order.  Every task reduces its centred rows by QR to
one triangle; triangles are stacked and reduced again in groups of ``FAN_IN`` until a single one is left, whose
Gramian is n times the covariance.  That triangle (dimension by dimension, whatever the number of rows) is
bidiagonalised by Householder reflections, its singular values come from the differential quotient-difference
algorithm with shifts, and each direction from a twisted factorisation at its singular value.

Cases: a row whose vector is null, empty, or holds null or non-finite entries is dropped, as is one whose length is
not the most frequent one (of several, the largest); null and repeated vec_ids are kept as they are and repeated rows
count each; a component without variance has ``whitened`` 0 in every row, ``explained`` 0, and no part in
``identity_error``; equal eigenvalues get orthonormal directions of their common space; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm.store import stash

SCALE, LIFT = 64, 1_000_000
COMPONENTS = 32
FAN_IN = 32
TRIANGLE = "part long, cells array<double>"
EPS = np.finfo(np.float64).eps


class Whitening(NamedTuple):
    """``directions`` has a unit eigenvector per column, ``scales`` the square roots of the eigenvalues."""

    n: int
    sums: list[int]
    directions: np.ndarray
    scales: np.ndarray
    explained: np.ndarray
    identity_error: float


def _whole_numbers(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a batch's vectors as int64."""
    column = batch.column(batch.schema.get_field_index("entries"))
    width = len(column[0]) if len(column) else 0
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).astype(np.int64).reshape(len(column), width) + LIFT


def _centred(batch: pa.RecordBatch, n: int, sums: list[int]) -> np.ndarray:
    """Rows of a batch without their mean: the whole part comes off exactly, then the fraction."""
    whole = _whole_numbers(batch) - np.array([s // n for s in sums], dtype=np.int64)
    return whole - np.array([s % n / n for s in sums])


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, entries) of the rows that take part."""
    finite = F.forall(
        "embedding", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))
    )
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    most = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = most["width"] if most else 0
    return rows.where(F.size("embedding") == width).select("vec_id", F.col("embedding").cast("array<double>").alias("entries"))


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and sum of each dimension's whole numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _whole_numbers(batch)
                n += len(x)
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
        if total is not None:
            # one row per task and dimension
            yield pa.RecordBatch.from_pydict(
                {"at": pa.array(np.arange(len(total))), "n": pa.array(np.full(len(total), n)), "total": pa.array(total)}
            )

    found = rows.mapInArrow(sums, "at long, n long, total long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    by_place = sorted(map(tuple, found.collect()))  # as many rows as a vector has entries
    return (by_place[0][1], [total for _, _, total in by_place]) if by_place else (0, [])


def _triangle(rows: np.ndarray) -> np.ndarray:
    """Square upper triangle with the Gramian of ``rows``."""
    width = rows.shape[1]
    if len(rows) < width:
        rows = np.vstack([rows, np.zeros((width - len(rows), width))])
    return np.linalg.qr(rows, mode="r")


def centred_triangle(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Triangle of all centred rows: QR per task, then of ``FAN_IN`` stacked triangles at a time."""
    width = len(sums)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = None
        for batch in batches:
            if batch.num_rows:
                x = _centred(batch, n, sums)
                own = _triangle(x if own is None else np.vstack([own, x]))
        if own is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()]), "cells": pa.array([own.ravel()])})

    def stack(group: pd.DataFrame) -> pd.DataFrame:
        cells = group.sort_values("part")["cells"]
        return pd.DataFrame({"part": [int(group["part"].min()) // FAN_IN], "cells": [_triangle(np.vstack([c.reshape(width, width) for c in cells])).ravel()]})

    triangles = stash(rows.mapInArrow(reduce_rows, TRIANGLE), "triangles")
    while triangles.count() > FAN_IN:
        triangles = stash(triangles.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(stack, TRIANGLE), "triangles")
    last = sorted(triangles.collect(), key=lambda r: r.part)  # at most FAN_IN triangles
    return _triangle(np.vstack([np.array(r.cells).reshape(width, width) for r in last]))


def bidiagonal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, right) with ``square = left @ B @ right.T`` by Householder reflections."""
    a, width = square.copy(), len(square)
    right = np.eye(width)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        length = np.linalg.norm(x)
        if length == 0:
            return None
        v = x.copy()
        v[0] += np.copysign(length, x[0])
        return v / np.linalg.norm(v)

    for k in range(width):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < width - 2:
            v = reflector(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= 2 * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float] | None:
    """One shifted transform; None when the shift passes the smallest value."""
    new_q, new_e = np.empty_like(q), np.empty_like(e)
    d = low = q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        new_q[k] = d + e[k]
        ratio = q[k + 1] / new_q[k] if new_q[k] > 0 else 0.0
        new_e[k] = e[k] * ratio
        d = d * ratio - shift if new_q[k] > 0 else q[k + 1] - shift
        low = min(low, d)
    if d < 0:
        return None
    new_q[-1] = d
    return new_q, new_e, low


def qd_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, in falling order.

    Each transform takes off a shift that must not pass the smallest value; a refused shift is cut to a quarter.
    """
    found: list[float] = []
    blocks = [(diagonal**2, upper**2, 0.0)]
    while blocks:
        q, e, taken = blocks.pop()
        low = 0.0
        while len(q):
            if len(q) == 1:
                found.append(taken + q[0])
                break
            small = np.flatnonzero(e <= EPS**2 * (taken + np.minimum(q[:-1], q[1:])))
            if len(small):
                cut = small[-1] + 1
                blocks.append((q[:cut], e[: cut - 1], taken))
                q, e, low = q[cut:], e[cut:], 0.0
                continue
            if len(q) == 2:  # the last two in closed form
                half, mix = (q[0] + q[1] + e[0]) / 2, q[0] * q[1]
                large = half + np.sqrt(max(0.0, half * half - mix))
                found += [taken + large, taken + (mix / large if large > 0 else 0.0)]
                break
            shift = max(0.0, low) * 0.98
            step = _qd_step(q, e, shift)
            while step is None:
                shift = shift / 4 if shift > EPS * taken + 1e-300 else 0.0
                step = _qd_step(q, e, shift)
                if step is None and shift == 0.0:  # rounding alone makes it negative
                    q = np.maximum(q, 0.0)
                    step = _qd_step(q, e, 0.0)
                    break
            if e[-1] > q[-1]:  # the small end belongs at the bottom
                step = _flipped(*step)
            q, e, low = step
            taken += shift
    return np.sort(np.maximum(np.array(found), 0.0))[::-1]


def _flipped(q: np.ndarray, e: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The same values with the qd array reversed, when its large values lie at the bottom."""
    return (q[::-1].copy(), e[::-1].copy(), low) if q[0] * 1.5 < q[-1] else (q, e, low)


def twisted_vector(diagonal: np.ndarray, upper: np.ndarray, value: float, tiny: float) -> np.ndarray:
    """Unit null vector of ``B.T B - value`` from the twisted factorisation with the smallest pivot."""
    width = len(diagonal)
    d, low = diagonal**2, upper / diagonal[:-1]
    s, p = np.empty(width), np.empty(width)
    down, up = np.empty(width - 1), np.empty(width - 1)

    def apart(x: float) -> float:
        return x if abs(x) > tiny else (tiny if x >= 0 else -tiny)

    s[0] = -value
    for k in range(width - 1):
        pivot = apart(d[k] + s[k])
        down[k] = d[k] * low[k] / pivot
        s[k + 1] = down[k] * low[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(width - 2, -1, -1):
        ratio = d[k] / apart(d[k] * low[k] ** 2 + p[k + 1])
        up[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    at = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(width)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at, width - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def directions(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values in falling order, right singular vectors as columns) of a square matrix."""
    width = len(triangle)
    size = np.linalg.norm(triangle)
    if size == 0:
        return np.zeros(width), np.eye(width)
    diagonal, upper, right = bidiagonal(triangle / size)
    diagonal = np.where(np.abs(diagonal) < EPS / width, EPS / width, diagonal)
    ends = np.flatnonzero(np.abs(upper) < EPS / width)
    pairs = []
    for low, high in zip([0, *(ends + 1)], [*(ends + 1), width]):
        own, above = diagonal[low:high], upper[low : high - 1]
        for value in qd_values(own, above):
            z = np.zeros(width)
            z[low:high] = twisted_vector(own, above, value, EPS**2) if high - low > 1 else 1.0
            pairs.append((value, z))
    pairs.sort(key=lambda pair: -pair[0])
    values, vectors = np.array([v for v, _ in pairs]), np.array([z for _, z in pairs]).T
    for k in range(width):
        # For well separated values this changes no digit.
        z = _apart(vectors[:, :k], vectors[:, k])
        if np.linalg.norm(z) < 0.9:
            z = _other_direction(diagonal, upper, values[k], vectors[:, :k])
        vectors[:, k] = z / np.linalg.norm(z)
    return values * size * size, right @ vectors


def _apart(known: np.ndarray, z: np.ndarray) -> np.ndarray:
    """``z`` without its parts along the columns of ``known``."""
    for _ in range(2):
        z = z - known @ (known.T @ z)
    return z


def _other_direction(diagonal: np.ndarray, upper: np.ndarray, value: float, known: np.ndarray) -> np.ndarray:
    """A direction at a nearly repeated value: inverse iteration, kept orthogonal to the known ones."""
    b = np.diag(diagonal) + np.diag(upper, 1)
    width = len(diagonal)
    moved = b.T @ b - (value + 4 * EPS * max(value, EPS)) * np.eye(width)
    z = _apart(known, np.cos(np.arange(1, width + 1) * 1.7 * (known.shape[1] + 1)))
    for _ in range(4):
        z /= np.linalg.norm(z)
        z = np.linalg.solve(moved, z)
        z = _apart(known, z / np.linalg.norm(z))
        z = _apart(known, z / np.linalg.norm(z))
    return z


def _projected(batch: pa.RecordBatch, model: Whitening) -> np.ndarray:
    scales = model.scales
    projected = _centred(batch, model.n, model.sums) @ model.directions
    return np.where(scales > 0, projected / np.where(scales > 0, scales, 1.0), 0.0)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Directions of the covariance of all ``rows`` (from :func:`usable`)."""
    n, sums = exact_sums(rows)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)
    squares, vectors = directions(centred_triangle(rows, n, sums))
    floor = squares[0] * (EPS * len(sums)) ** 2
    shown = min(components, len(sums))
    squares = np.where(squares > floor, squares, 0.0)
    total = squares.sum()
    scales = np.sqrt(squares[:shown] / n)
    explained = squares[:shown] / total if total > 0 else np.zeros(shown)
    first = Whitening(n, sums, vectors[:, :shown].copy(), scales, explained, 0.0)
    return first._replace(identity_error=_identity_error(rows, first))


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened covariance minus the identity, over components with variance."""
    scales = model.scales
    size = len(scales)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                w = _projected(batch, model)
                total += w.T @ w
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(size * size)), "total": pa.array(total.ravel())})

    cells = rows.mapInArrow(products, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    covariance = np.zeros(size * size)
    for r in cells:  # components squared
        covariance[r["at"]] = r["total"] / model.n
    wanted = np.outer(scales > 0, scales > 0)
    return float(np.abs(np.where(wanted, covariance.reshape(size, size) - np.eye(size), 0.0)).max(initial=0.0))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row per vector and component.

    ``deviation`` is a decimal, exact for any number of rows.
    """
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    n, size = model.n, len(model.scales)
    floors = np.array([s // n for s in model.sums] if n else [], dtype=np.int64)
    rests = np.array([s % n for s in model.sums] if n else [], dtype=np.int64)
    rest_squares = sum(int(r) ** 2 for r in rests)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _whole_numbers(batch) - floors
            # n * x - sum is n * u - rest in each dimension
            square, cross = (u * u).sum(axis=1).tolist(), (u * rests).sum(axis=1).tolist()
            deviation = pa.array([Decimal(n * n * a - 2 * n * b + rest_squares) for a, b in zip(square, cross)], pa.decimal128(38, 0))
            w = _projected(batch, model)
            row = pa.array(np.repeat(np.arange(batch.num_rows), size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()).take(row),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(len(row), n)),
                    deviation.take(row),
                    pa.array(w.ravel()),
                    pa.array(np.tile(model.explained, batch.num_rows)),
                    pa.array(np.full(len(row), model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)


def whitened_embeddings(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Fit on every usable row and whiten every usable row."""
    rows = usable(embeddings)
    return whiten(rows, fit(rows, components))
