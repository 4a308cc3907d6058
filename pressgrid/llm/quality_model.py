"""Quality scores by a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after another and adds a shrunken tree of two cuts over the feature's bins to its
lookup table; then the pairs of features that best explain what is left get two-way tables in the same manner.  A
score is a sum of table cells, so scoring bins the features and adds.

Features count signs and words of the whole text; label, language, source and id are none.  Cases: null and empty
texts have zero counts and are scored like any row; repeated rows are scored one by one; an empty table gives no rows;
without labels of both kinds every score is the share of good labels, or 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm import learning, words as W

HOLD = (4, 2)  # crc32 of the doc_id mod 4 is 2: held out
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 64, 16, 6
FEATURES = (
    "words_log2 word_length symbols_per_word upper_share digit_share exclamations_per_word marks_per_word distinct_share "
    "adjacent_repeats top_share non_ascii_share breaks_per_word repeated_triples"
).split()


class Model(NamedTuple):
    bias: float
    edges: list[np.ndarray]  # inner bin edges per feature
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature matrix of a slice, one row per text."""
    count = len(offsets) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    def table(signs: bytes) -> np.ndarray:
        out = np.zeros(256, bool)
        out[list(signs)] = True
        return out

    found = W.find_words(data, offsets)
    hashes, row = W.hash_spans(data, found.starts, found.ends), found.row
    n = np.bincount(row, minlength=count).astype(float)
    some = np.maximum(n, 1)
    letters = np.maximum(total(((data | 32) >= 97) & ((data | 32) <= 122)), 1)
    of_row = W.mix(row.astype(np.uint64) + np.uint64(1))
    _, first, times = np.unique(hashes + of_row, return_index=True, return_counts=True)
    top = np.zeros(count)
    np.maximum.at(top, row[first], times.astype(float))
    same = row[1:] == row[:-1]
    again = np.bincount(row[1:][same & (hashes[1:] == hashes[:-1])], minlength=count)
    starts = W.window_starts(found, 3)
    triples = np.bincount(row[starts], minlength=count).astype(float)
    _, once = np.unique(W.window_hashes(hashes, 3)[starts] + of_row[starts], return_index=True)
    distinct_triples = np.bincount(row[starts][once], minlength=count)
    return np.stack(
        [
            np.log2(n + 1),
            (total(~W.space_table()[data])) / some,
            total(table(b"#*$%&|<>")[data]) / some,
            total((data >= 65) & (data <= 90)) / letters,
            total((data >= 48) & (data <= 57)) / some,
            total(data == 33) / some,
            total(table(b".,;:?'\"()-")[data]) / some,
            np.bincount(row[first], minlength=count) / some,
            again / some,
            top / some,
            total(data >= 128) / np.maximum(offsets[1:] - offsets[:-1], 1),
            total(data == 10) / some,
            (triples - distinct_triples) / np.maximum(triples, 1),
        ],
        axis=1,
    )


def _two_cuts(gradient: np.ndarray, hessian: np.ndarray, least: float = 5.0) -> np.ndarray:
    """Value per bin of a tree with up to two cuts over ordered bins."""
    value = np.zeros(len(gradient))

    def cut(low: int, high: int) -> int | None:
        g, h = np.cumsum(gradient[low:high]), np.cumsum(hessian[low:high])
        if high - low < 2:
            return None
        left, right = h[:-1], h[-1] - h[:-1]
        gain = g[:-1] ** 2 / (left + 1) + (g[-1] - g[:-1]) ** 2 / (right + 1) - g[-1] ** 2 / (h[-1] + 1)
        gain[(left < least * 0.05) | (right < least * 0.05)] = 0
        at = int(np.argmax(gain))
        return low + at + 1 if gain[at] > 1e-9 else None

    leaves = [(0, len(gradient))]
    first = cut(0, len(gradient))
    if first is not None:
        leaves = [(0, first), (first, len(gradient))]
        # The second cut goes to the leaf with more left to explain.
        leaves.sort(key=lambda leaf: -np.abs(gradient[leaf[0] : leaf[1]]).sum())
        second = cut(*leaves[0])
        if second is not None:
            low, high = leaves.pop(0)
            leaves += [(low, second), (second, high)]
    for low, high in leaves:
        value[low:high] = -gradient[low:high].sum() / (hessian[low:high].sum() + 1)
    return value


def _quadrants(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, value per cell) of the best tree that cuts each of two features once."""
    g, h = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    parts_g = [g[:-1, :-1], g[:-1, -1:] - g[:-1, :-1], g[-1:, :-1] - g[:-1, :-1]]
    parts_h = [h[:-1, :-1], h[:-1, -1:] - h[:-1, :-1], h[-1:, :-1] - h[:-1, :-1]]
    parts_g.append(g[-1, -1] - sum(parts_g))
    parts_h.append(h[-1, -1] - sum(parts_h))
    gain = sum(a**2 / (b + 1) for a, b in zip(parts_g, parts_h))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = np.zeros(gradient.shape)
    for where, a, b in zip((np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]), parts_g, parts_h):
        value[where] = -a[i, j] / (b[i, j] + 1)
    return float(gain[i, j]), value


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.15) -> Model:
    """Fit on a feature matrix; its number of rows is the caller's bound."""
    share = float(y.mean()) if len(y) else 1.0
    width = len(FEATURES)
    bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(y) or share in (0.0, 1.0):
        return Model(bias, [np.empty(0)] * width, [np.zeros(1)] * width, [np.empty(0)] * width, [])
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(width)]
    pair_edges = [np.unique(np.quantile(x[:, j], np.arange(1, PAIR_BINS) / PAIR_BINS)) for j in range(width)]
    bins = [np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)]
    coarse = [np.searchsorted(pair_edges[j], x[:, j], side="left") for j in range(width)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    z = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            size = len(tables[j])
            step = rate * _two_cuts(np.bincount(bins[j], weights=g, minlength=size), np.bincount(bins[j], weights=h, minlength=size))
            tables[j] += step
            z += step[bins[j]]

    def cells(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(pair_edges[a]) + 1, len(pair_edges[b]) + 1
        return coarse[a] * shape[1] + coarse[b], shape

    def tree(cell: np.ndarray, shape: tuple[int, int]) -> tuple[float, np.ndarray]:
        g, h = slopes()
        size = shape[0] * shape[1]
        return _quadrants(
            np.bincount(cell, weights=g, minlength=size).reshape(shape), np.bincount(cell, weights=h, minlength=size).reshape(shape)
        )

    wide = [j for j in range(width) if len(pair_edges[j])]
    ranked = sorted(((tree(*cells(a, b))[0], a, b) for a, b in combinations(wide, 2)), reverse=True)[:PAIRS]
    pair_tables = {(a, b): np.zeros(cells(a, b)[1]) for _, a, b in ranked}
    for _ in range(pair_rounds):
        for (a, b), table in pair_tables.items():
            cell, shape = cells(a, b)
            step = rate * tree(cell, shape)[1]
            table += step
            z += step.ravel()[cell]
    return Model(bias, edges, tables, pair_edges, [(a, b, t) for (a, b), t in pair_tables.items()])


def scores(model: Model, x: np.ndarray) -> np.ndarray:
    """Probability of good quality per row: bins and additions."""
    z = np.full(len(x), model.bias)
    for j, (edges, table) in enumerate(zip(model.edges, model.tables)):
        z += table[np.searchsorted(edges, x[:, j], side="left")]
    coarse = {j: np.searchsorted(model.pair_edges[j], x[:, j], side="left") for a, b, _ in model.pairs for j in (a, b)}
    for a, b, table in model.pairs:
        z += table[coarse[a], coarse[b]]
    return 1 / (1 + np.exp(-z))


def train(documents: DataFrame, labels: DataFrame, limit: int = learning.SAMPLE_ROWS) -> Model:
    """Model fitted on at most ``limit`` labelled rows; only their features reach the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                x = features(data, offsets)
                columns = [pa.array(x[:, j]) for j in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("y").slice(low, high - low)], names=[*FEATURES, "y"])

    schema = ", ".join(f"{name} double" for name in FEATURES) + ", y int"
    sample = learning.training_rows(documents, labels, "quality", *HOLD, limit).mapInArrow(read, schema).toPandas()
    sample = sample.sort_values([*FEATURES, "y"])  # rows come in no fixed order
    return fit(sample[FEATURES].to_numpy(), sample["y"].to_numpy(float))


def quality(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every document."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                found = scores(model, features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(found)], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, model: Model) -> DataFrame:
    """The documents the model does not reject, unchanged."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                yield batch.slice(low, high - low).filter(pa.array(scores(model, features(data, offsets)) >= THRESHOLD))

    return documents.mapInArrow(keep, documents.schema)
