"""Static binary-fuse filters over sets of 64-bit keys, built and asked in numpy.

Each key has three slots in neighbouring segments; a key's fingerprint is the exclusive or of its slots.  Filling peels
slots that a single key uses, all of a round at once, and assigns in the opposite order.  One byte a slot: a foreign
key passes with a probability of 1/256, a member always.
"""

from __future__ import annotations

from math import ceil, floor, log
from typing import NamedTuple

import numpy as np

from pressgrid.llm.words import mix


class Filter(NamedTuple):
    seed: int
    segment: int  # slots of a segment, a power of two
    spans: int  # segments a key's first slot can lie in
    table: np.ndarray


def _places(keys: np.ndarray, seed: int, segment: int, spans: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of shape 3 x keys, fingerprints)."""
    h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    first = ((h >> np.uint64(32)) * np.uint64(spans * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(16)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack((first, second, third)).astype(np.int64), (mix(h) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> Filter:
    """Filter over distinct keys."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(2, len(keys))
    segment = min(1 << 18, 1 << max(2, floor(log(n) / log(3.33) + 2.25)))
    slots = ceil(n * max(1.125, 0.875 + 0.25 * log(1e6) / log(n)))
    spans = max(1, ceil(slots / segment) - 2)
    for seed in range(1, 1000):
        table = _fill(keys, seed, segment, spans)
        if table is not None:
            return Filter(seed, segment, spans, table)
    raise RuntimeError("no seed separates the keys")


def _fill(keys: np.ndarray, seed: int, segment: int, spans: int) -> np.ndarray | None:
    size = (spans + 2) * segment
    places, prints = _places(keys, seed, segment, spans)
    uses = np.bincount(places.ravel(), minlength=size)
    # The exclusive or of the numbers of the keys that use a slot: at one use, the key's own number.
    owner = np.zeros(size, np.int64)
    numbers = np.arange(len(keys))
    for row in places:
        np.bitwise_xor.at(owner, row, numbers)
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    lone, left = np.flatnonzero(uses == 1), len(keys)
    while len(lone):
        peeled, at = np.unique(owner[lone], return_index=True)
        rounds.append((peeled, lone[at]))
        left -= len(peeled)
        touched = places[:, peeled]
        for row in touched:
            np.subtract.at(uses, row, 1)
            np.bitwise_xor.at(owner, row, peeled)
        slots = np.unique(touched)
        lone = slots[uses[slots] == 1]
    if left:
        return None
    table = np.zeros(size, np.uint8)
    for peeled, slot in reversed(rounds):
        own = places[:, peeled]
        table[slot] = 0
        table[slot] = prints[peeled] ^ table[own[0]] ^ table[own[1]] ^ table[own[2]]
    return table


def might_hold(filter_: Filter, keys: np.ndarray) -> np.ndarray:
    """Whether each key passes; never false for a member."""
    places, prints = _places(keys.astype(np.uint64), filter_.seed, filter_.segment, filter_.spans)
    return prints == filter_.table[places[0]] ^ filter_.table[places[1]] ^ filter_.table[places[2]]
