"""Importance draw: documents that look like a target set, by hashed word runs.

A feature is a run of 1 to ``max_run`` consecutive words, joined by one space; its bucket is the CRC-32 of its UTF-8
bytes modulo the number of buckets.  A bucket's gain compares its share in the target set with its share in the corpus,
a document's weight is the sum over its features, and noise fixed by the doc_id turns a cut by score into a draw
without replacement.

The CRC is linear over bits: that of a span of n bytes is a constant for n, XOR one table entry for each byte and its
distance from the end.  So all spans of a batch are hashed by one lookup and one ``bitwise_xor.reduceat``.  Spans of more
than ``BLOCK`` bytes are cut into blocks from their end, and each block's part is moved over the bytes behind it by
tables for 1, 2, 4... blocks.

Cases: null and empty texts have no features and weight 0; a null doc_id draws its noise as an empty id; repeated rows
are scored, counted and drawn one by one, as are ties of score and doc_id, in an order fixed by one written table; with
no target text, or no documents, gains still exist and an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm.store import stash
from pressgrid.llm.words import find_words, gather, lower_table, text_slices

BLOCK = 64
POLYNOMIAL = 0xEDB88320
BUCKETS = 10_000
MIN_WORDS = 20
DRAWN_PERCENT = 10
SEED = "2024"


@lru_cache(maxsize=1)
def word_gaps() -> np.ndarray:
    """Bytes that no word holds: all of ASCII but digits and a-z (A-Z is lower-cased before)."""
    table = np.zeros(256, dtype=bool)
    table[:128] = True
    table[48:58] = table[97:123] = False
    return table


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """Effect of one byte on an all-zero register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _past_zero(register: np.ndarray) -> np.ndarray:
    return (register >> np.uint32(8)) ^ byte_table()[register & np.uint32(255)]


@lru_cache(maxsize=1)
def position_table() -> np.ndarray:
    """``table[distance from the end, byte]`` for the distances inside a block."""
    rows = [byte_table()]
    for _ in range(BLOCK - 1):
        rows.append(_past_zero(rows[-1]))
    return np.array(rows)


@lru_cache(maxsize=32)
def block_shift(power: int) -> np.ndarray:
    """``table[k, byte]``: register with ``byte`` at its k-th place, moved over ``2 ** power`` blocks of zero bytes."""
    if power:
        half = block_shift(power - 1)
        return np.array([_moved(row, half) for row in half])
    register = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(BLOCK):
        register = _past_zero(register)
    return register


def _moved(register: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = table[0][register & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ table[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def _moved_blocks(register: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Each register moved over its own number of blocks of zero bytes."""
    out = register.copy()
    for power in range(int(blocks.max(initial=0)).bit_length()):
        chosen = (blocks >> power) & 1 == 1
        out[chosen] = _moved(out[chosen], block_shift(power))
    return out


def _length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC part of a span's length alone: the start value moved over that many bytes, inverted."""
    register = np.full(len(lengths), 0xFFFFFFFF, dtype=np.uint32)
    rest = lengths % BLOCK
    for step in range(BLOCK - 1):
        chosen = rest > step
        if not chosen.any():
            break
        register[chosen] = _past_zero(register[chosen])
    return ~_moved_blocks(register, lengths // BLOCK)


def crc_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes, as uint32; spans may overlap and be empty."""
    sizes, back = np.unique(lengths, return_inverse=True)
    out = _length_constants(sizes)[back]
    full = np.flatnonzero(lengths > 0)
    if not len(full):
        return out
    starts, lengths = starts[full], lengths[full]
    # Blocks of each span, counted from its end; the first block in reading order may be short.
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    of = np.repeat(np.arange(len(full)), blocks)
    behind = blocks[of] - 1 - (np.arange(len(of)) - first[of])
    ends = (starts + lengths)[of] - behind * BLOCK
    begins = np.maximum(ends - BLOCK, starts[of])
    sizes = ends - begins
    at = np.cumsum(sizes) - sizes
    distance = np.repeat(at + sizes, sizes) - np.arange(int(sizes.sum())) - 1
    parts = np.bitwise_xor.reduceat(position_table()[distance, gather(data, begins, sizes)], at)
    out[full] ^= np.bitwise_xor.reduceat(_moved_blocks(parts, behind), first)
    return out


def _spaced(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All words, each followed by one space."""
    out = np.full(int(lengths.sum()) + len(lengths), 32, dtype=np.uint8)
    skip = np.arange(len(lengths))
    place = np.arange(int(lengths.sum())) + np.repeat(skip, lengths)
    out[place] = gather(data, starts, lengths)
    return out


def feature_buckets(column: pa.Array, buckets: int, max_run: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words per row, row of each feature, bucket of each feature) per slice of texts."""
    for low, high, data, offsets in text_slices(column):
        data = lower_table()[data]
        words = find_words(data, offsets, word_gaps())
        n_words = np.bincount(words.row, minlength=high - low)
        lengths = words.ends - words.starts
        joined = _spaced(data, words.starts, lengths)
        begins = np.cumsum(lengths + 1) - (lengths + 1)
        rows, found = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for run in range(1, max_run + 1):
            last = np.arange(run - 1, len(lengths))
            begin = last - (run - 1)
            inside = words.row[begin] == words.row[last]
            begin, last = begin[inside], last[inside]
            spans = begins[last] + lengths[last] - begins[begin]
            rows.append(words.row[begin])
            found.append((crc_spans(joined, begins[begin], spans) % np.uint32(buckets)).astype(np.int64))
        yield low, high, n_words, np.concatenate(rows), np.concatenate(found)


def bucket_counts(texts: DataFrame, buckets: int, max_run: int) -> np.ndarray:
    """Features of all ``texts`` in each bucket; every task sends one histogram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for *_, found in feature_buckets(batch.column(0), buckets, max_run):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held), "n": pa.array(total[held])})

    counted = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed shares, per bucket."""
    s, t, size = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000.0 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def _weigh(gain: np.ndarray, max_run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low, high, n_words, row, found in feature_buckets(texts, len(gain), max_run):
                weight = np.zeros(high - low, dtype=np.int64)
                np.add.at(weight, row, gain[found])
                columns = {
                    "doc_id": ids.slice(low, high - low).cast(pa.int64()),
                    "n_words": pa.array(n_words.astype(np.int64)),
                    "n_features": pa.array(np.bincount(row, minlength=high - low).astype(np.int64)),
                    "weight": pa.array(weight),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return weigh


def scores(documents: DataFrame, gain: np.ndarray, max_run: int = 1, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    weighed = documents.select("doc_id", "text").mapInArrow(
        _weigh(gain, max_run), "doc_id long, n_words long, n_features long, weight long"
    )
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    noise = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.log(-F.log(noise))))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a partition in their order."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(seen + 1, seen + n + 1))],
            names=[*batch.schema.names, "part", "place"],
        )
        seen += n


def ranked(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = DRAWN_PERCENT) -> DataFrame:
    """Every document with its rank among the drawn ones; null where it isn't drawn.

    Rows are dealt by ranges of (score, doc_id), numbered inside their range, and moved by the rows of the ranges before.
    """
    scored = stash(scored.withColumn("row", F.monotonically_increasing_id()), "importance-scores")
    able = F.col("n_words") >= min_words
    columns = ["doc_id", "n_features", "weight", "score", "row"]
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    dealt = scored.where(able).select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stash(
        dealt.mapInArrow(_numbered, "doc_id long, n_features long, weight long, score long, row long, part int, place long"),
        "importance-ranges",
    )
    # One number per partition of the range exchange.
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy("part").agg(F.max("place").alias("n")).collect())
    total = sum(n for _, n in sizes)
    before = np.cumsum([0, *(n for _, n in sizes)])
    offsets = scored.sparkSession.createDataFrame([(part, int(b)) for (part, _), b in zip(sizes, before)], "part int, before long")
    rank = F.col("before") + F.col("place")
    drawn = numbered.join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= percent * total // 100, rank))
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
    shown = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*shown).unionByName(rest.select(*shown))


def importance_draw(
    documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_run: int = 1, min_words: int = MIN_WORDS,
    percent: int = DRAWN_PERCENT, seed: str = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: a draw of those like the texts of ``target``."""
    gain = gains(bucket_counts(documents, buckets, max_run), bucket_counts(target, buckets, max_run))
    return ranked(scores(documents, gain, max_run, seed), min_words, percent)
