"""Packing of tokenised documents into sequences of equal length: first-fit decreasing by a tournament tree.

A document's ids and an end mark are cut into full sequences and one remainder.  Pieces are dealt by a hash over
partitions and, there, over groups of bounded size; each group is packed on its own, so no step sees all pieces.

Cases: null text is empty and gives the end mark alone; repeated rows are packed one by one; an empty table gives no
pieces; other columns are ignored.  A piece's ids can be carried along (``keep_ids``).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm import bpe, words as W

SEQUENCE = 1024
END_ID = 0
GROUP_PIECES = 1 << 15


class TournamentTree:
    """Free room of bins; finds the first bin with room for an item in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """(bin, room left in it before the item)."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        had = free[node]
        free[node] = had - size
        found = node - self.leaves
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
        return found, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each item; bins are numbered from 0 without gaps."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = TournamentTree(max(1, len(sizes) - full), capacity)
    for k in order[full:].tolist():
        at, free = tree.put(int(sizes[k]))
        bins[k], offsets[k] = full + at, capacity - free
    return bins, offsets


def cut_pieces(documents: DataFrame, vocabulary_path: str, keep_ids: bool = False, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and ids (binary, unsigned 32-bit little-endian) if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.BatchEncoder(vocabulary_path)
        mark = np.array([END_ID], "<u4")
        for batch in batches:
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                ids, counts = encoder.slice_ids(data, offsets)
                ids = ids.astype("<u4")
                ends = np.cumsum(counts)
                row, start, length, code, total, kept = [], [], [], [], [], []
                for k, (first, end) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    own = np.concatenate((ids[first:end], mark))
                    for at in range(0, len(own), sequence):
                        part = own[at : at + sequence].tobytes()
                        row.append(low + k)
                        start.append(at)
                        length.append(len(part) // 4)
                        code.append(crc32(part))
                        total.append(len(own))
                        if keep_ids:
                            kept.append(part)
                columns = [batch.column("doc_id").take(pa.array(row, pa.int64()))]
                columns += [pa.array(x, pa.int64()) for x in (start, length, code, total)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``sequence``."""

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        following = TaskContext.get().partitionId() << 40
        held: list[pd.DataFrame] = []
        count = 0

        def packed() -> pd.DataFrame:
            nonlocal following
            group = pd.concat(held, ignore_index=True)
            bins, offsets = first_fit_decreasing(group["length"].to_numpy(), sequence)
            group["sequence_id"], group["offset"] = following + bins, offsets
            following += int(bins.max()) + 1
            return group.drop(columns="dealt")

        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count >= group_pieces:
                yield packed()
                held, count = [], 0
        if count:
            yield packed()

    # The order inside a partition is fixed by the rows themselves, so a task that runs again packs alike.
    dealt = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")
    spread = pieces.withColumn("dealt", dealt).repartition("dealt").sortWithinPartitions("dealt", "doc_id", "start")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return spread.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, vocabulary_path: str, keep_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence."""
    return pack(cut_pieces(documents, vocabulary_path, keep_ids))
