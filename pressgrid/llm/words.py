"""Vectorised words, word hashes and word-window hashes of Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D.  UTF-8 never uses those
bytes inside a longer character, so working on bytes is exact.  Columns are cut
into slices of bounded size; a longer single text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
ASCII_SPACE = (9, 10, 11, 12, 13, 32)


class Words(NamedTuple):
    """Words of a slice: byte positions (from the slice's first byte), row in the slice."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray


@lru_cache(maxsize=1)
def space_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(ASCII_SPACE)] = True
    return table


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Byte -> byte with A-Z lower-cased, all else unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (the splitmix finaliser)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@lru_cache(maxsize=16)
def random_row(size: int, seed: int) -> np.ndarray:
    """Fixed pseudo-random odd 64-bit numbers."""
    numbers = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(numbers + np.uint64(seed)) | np.uint64(1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) per slice of a column."""
    data, offsets = text_bytes(column)
    for low, high in slices(offsets, limit):
        own = offsets[low : high + 1]
        yield low, high, data[own[0] : own[-1]], own - own[0]


def find_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None) -> Words:
    """All words of a slice, in order; words never span rows."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return Words(none, none, none)
    inside = ~(space_table() if space is None else space)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    firsts, lasts = offsets[:-1][full], offsets[1:][full] - 1
    begins[firsts] = inside[firsts]
    stops[lasts] = inside[lasts]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return Words(starts, ends, np.searchsorted(offsets, starts, side="right") - 1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span: a sum of byte codes times random numbers by place, mixed with the length."""
    lengths = ends - starts
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    longest = int(lengths.max())
    by_place = random_row(1 << max(8, longest.bit_length()), seed)
    codes = random_row(256, seed + 7)
    picked = data[np.repeat(starts, lengths) + place]
    sums = np.add.reduceat(codes[picked] * by_place[place], np.minimum(first, max(0, len(place) - 1)))
    sums[lengths == 0] = 0
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(word_hashes: np.ndarray, size: int, seed: int = 3) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words, by its first word; runs may span rows."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    factors = random_row(64 if size <= 64 else size, seed)
    sums = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        sums += word_hashes[k : k + n] * factors[k]
    return mix(sums)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Word numbers at which a run of ``size`` words lies inside one row."""
    n = len(words.row) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(words.row[:n] == words.row[size - 1 :])


def gather(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pool pieces [begin, begin + length) one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(begins - (ends - lengths), lengths) + np.arange(total)]
