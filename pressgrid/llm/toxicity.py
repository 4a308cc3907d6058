"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its words with A-Z lower-cased and the words' first bytes, each hashed to one of 2^18 features that is
there or not.  The machine adds a weight per term and the product of two terms' factors per pair, so pairs of terms count
beyond their single weights.  Training is AdaGrad with a proximal step that sets weights and factors without evidence to
zero; scoring reads whole texts and keeps only terms with weight.

Cases: null and empty texts have no terms and get the intercept's score; repeated rows are scored one by one; an empty
table gives no rows; without labels of both kinds every score is the share of toxic labels, or 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm import learning, words as W

BITS = 18
PREFIXES = (4, 5, 6)
FACTORS = 4
HOLD = (5, 0)  # crc32 of the doc_id mod 5 is 0: held out


class Machine(NamedTuple):
    bias: float
    features: np.ndarray  # sorted feature numbers with weight
    weights: np.ndarray
    factors: np.ndarray


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all terms of a slice, with repetitions."""
    lower = W.lower_table()[data]
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    starts, ends, row = W.find_words(lower, offsets, space=~letter)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lengths = ends - starts
    inside = np.repeat(starts, lengths) + (place := np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    values = np.zeros(len(data) + 1, np.uint64)
    by_place = W.random_row(1 << max(8, int(lengths.max()).bit_length()), 11)
    values[inside + 1] = W.random_row(256, 12)[lower[inside]] * by_place[place]
    sums = np.cumsum(values)
    found = [W.mix(sums[ends] - sums[starts])]
    rows = [row]
    for size in PREFIXES:
        longer = lengths > size
        found.append(W.mix(sums[starts[longer] + size] - sums[starts[longer]] + np.uint64(size)))
        rows.append(row[longer])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(rows: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((rows << BITS) | features)
    return keys >> BITS, keys & ((1 << BITS) - 1)


def term_sets(texts: DataFrame) -> DataFrame:
    """(features as 32-bit binary, y) per row of (text, y)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                rows, features = distinct(*terms(data, offsets))
                cuts = np.searchsorted(rows, np.arange(1, high - low))
                own = [x.astype("<i4").tobytes() for x in np.split(features, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column("y").slice(low, high - low)], names=["terms", "y"])

    return texts.mapInArrow(read, "terms binary, y int")


def fit(sets: list[np.ndarray], y: np.ndarray, passes: int = 10, rate: float = 0.15, batch: int = 64) -> Machine:
    """Fit on rows of distinct features; the sample's size is the caller's bound."""
    share = float(y.mean()) if len(y) else 0.0
    nothing = Machine(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    if not len(y) or share in (0.0, 1.0):
        return nothing
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets)
    df = np.bincount(flat, minlength=1 << BITS)
    features = np.flatnonzero((df >= 4) & (df <= 0.5 * len(sets)))
    number = np.full(1 << BITS, -1, np.int64)
    number[features] = np.arange(len(features))
    rows = np.repeat(np.arange(len(sets)), sizes)
    keep = number[flat] >= 0
    rows, flat = rows[keep], number[flat[keep]]
    begin = np.searchsorted(rows, np.arange(len(sets) + 1))
    random = np.random.default_rng(7)
    n = len(features)
    w, v, bias = np.zeros(n), random.normal(0, 0.01, (n, FACTORS)), nothing.bias
    gw, gv, gb = np.full(n, 1e-6), np.full(n, 1e-4), 1e-6
    for _ in range(passes):
        for some in np.array_split(random.permutation(len(sets)), max(1, len(sets) // batch)):
            lengths = begin[some + 1] - begin[some]
            own = np.repeat(np.arange(len(some)), lengths)
            x = W.gather(flat, begin[some], lengths)
            linear = np.bincount(own, weights=w[x], minlength=len(some))
            sums = np.stack([np.bincount(own, weights=v[x, f], minlength=len(some)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(own, weights=(v[x] ** 2).sum(axis=1), minlength=len(some))
            z = bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]
            used, slot = np.unique(x, return_inverse=True)
            dw = np.bincount(slot, weights=error[own], minlength=len(used)) / len(some)
            part = error[own][:, None] * (sums[own] - v[x])
            dv = np.stack([np.bincount(slot, weights=part[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1) / len(some)
            gb += float(error.mean()) ** 2
            bias -= rate * float(error.mean()) / np.sqrt(gb)
            gw[used] += dw**2
            step = rate / np.sqrt(gw[used])
            moved = w[used] - step * dw
            w[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * 4e-4)
            gv[used] += (dv**2).sum(axis=1)
            step = (rate * 0.3 / np.sqrt(gv[used]))[:, None]
            moved = v[used] - step * dv
            norm = np.sqrt((moved**2).sum(axis=1, keepdims=True)) + 1e-12
            v[used] = moved * np.maximum(0, 1 - step * 1e-3 / norm)
    kept = (w != 0) | (np.abs(v).sum(axis=1) > 0.02)
    return Machine(float(bias), features[kept], w[kept], v[kept])


def scores(machine: Machine, rows: np.ndarray, features: np.ndarray, count: int) -> np.ndarray:
    """Probability per row from its distinct (row, feature) pairs."""
    at = np.minimum(np.searchsorted(machine.features, features), max(0, len(machine.features) - 1))
    hit = machine.features[at] == features if len(machine.features) else np.zeros(len(features), bool)
    rows, at = rows[hit], at[hit]
    z = machine.bias + np.bincount(rows, weights=machine.weights[at], minlength=count)
    for f in range(FACTORS):
        own = machine.factors[at, f]
        z += 0.5 * (np.bincount(rows, weights=own, minlength=count) ** 2 - np.bincount(rows, weights=own**2, minlength=count))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(documents: DataFrame, labels: DataFrame, limit: int = learning.SAMPLE_ROWS) -> Machine:
    """Machine fitted on at most ``limit`` labelled rows; only their term sets reach the driver."""
    sample = term_sets(learning.training_rows(documents, labels, "toxic", *HOLD, limit)).toArrow()
    sets = [np.frombuffer(x, "<i4").astype(np.int64) for x in sample.column("terms").to_pylist()]
    # Rows come in no fixed order; sorting makes the fit repeatable.
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), sets[k].tobytes()))
    y = np.array(sample.column("y").to_pylist(), float)
    return fit([sets[k] for k in order], y[order] if len(order) else y)


def toxicity(documents: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score, predicted for every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                rows, features = terms(data, offsets)
                known = np.isin(features, machine.features, kind="table") if len(features) else np.zeros(0, bool)
                found = scores(machine, *distinct(rows[known], features[known]), high - low)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(found)], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
