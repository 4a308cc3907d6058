"""Removal of word passages that an earlier document holds, by level-wise doubling.

A window is a run of consecutive words of one document.  The shortest level has windows of half the wanted length;
only where those occur in two or more documents are they extended to twice the length, and so on up to the wanted
one, each level looking at survivors alone.  At the first level one window of every wanted window stands for it: the
one with the smallest hash, which equal passages choose alike, so a quarter of the positions is dealt out.

A word goes if a window over it also starts in a document with a smaller doc_id.  Windows are those of the input, and
the first document keeps its passage.  Windows are compared by 95 bits of hash (64 + 31).

Cases: null text has no words; texts shorter than a window lose nothing; a null doc_id is greater than all others, and
documents with the same doc_id (or both null) take nothing from each other; repeated rows are treated alike; an empty
table gives no rows; other columns pass through unless they are named like the added ones, which replace them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pressgrid.llm import words as W
from pressgrid.llm.store import stash

WINDOW = 13
LAST = (1 << 63) - 1  # stands for a null doc_id


def levels(window: int, least: int = 7) -> list[int]:
    """Window lengths from the shortest level to the wanted one, each at most twice the one before."""
    found = [window]
    while found[0] > least:
        found.insert(0, -(-found[0] // 2))
    return found


def standing(hashes: np.ndarray, starts: np.ndarray, inner: int, outer: int) -> np.ndarray:
    """For windows of ``outer`` words at ``starts``, the start of the inner window with the smallest hash (leftmost)."""
    if not len(starts):
        return starts
    choice = np.stack([hashes[starts + k] for k in range(outer - inner + 1)])
    return starts + np.argmin(choice, axis=0)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")


def first_level(documents: DataFrame, window: int, inner: int) -> DataFrame:
    """(hash, doc, at): the standing inner windows of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                words = W.find_words(data, offsets)
                hashes = W.window_hashes(W.hash_spans(data, words.starts, words.ends), inner)
                at = np.unique(standing(hashes, W.window_starts(words, window), inner, window))
                row = words.row[at]
                first = np.searchsorted(words.row, row)
                yield pa.RecordBatch.from_arrays(
                    [_signed(hashes[at]), pa.array(ids[low:high][row]), pa.array((at - first).astype(np.int32))], names=["hash", "doc", "at"]
                )

    return _keyed(documents).mapInArrow(read, "hash long, doc long, at int")


def extended(documents: DataFrame, places: DataFrame, inner: int, outer: int, stand: bool) -> DataFrame:
    """(hash, check, doc, at): windows of ``outer`` words over the inner windows found at ``places`` (doc, ats).

    With ``stand``, only those whose standing inner window was found.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("ats")
            begin, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                words = W.find_words(data, offsets)
                own = W.hash_spans(data, words.starts, words.ends)
                count = np.bincount(words.row, minlength=high - low)
                first = np.cumsum(count) - count
                part = begin[low : high + 1]
                listed = np.repeat(first, np.diff(part)) + flat[part[0] : part[-1]]
                listed = listed[flat[part[0] : part[-1]] < np.repeat(count, np.diff(part))]
                hit = np.zeros(len(words.row) + 1, bool)
                hit[listed] = True
                starts = W.window_starts(words, outer)
                if stand:
                    starts = starts[hit[standing(W.window_hashes(own, inner), starts, inner, outer)]]
                else:
                    reach = np.concatenate(([0], np.cumsum(hit)))
                    starts = starts[reach[starts + outer - inner + 1] > reach[starts]]
                row = words.row[starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        _signed(W.window_hashes(own, outer)[starts]),
                        pa.array((W.window_hashes(own, outer, 91)[starts] & np.uint64(0x7FFFFFFF)).astype(np.int32)),
                        pa.array(ids[low:high][row]),
                        pa.array((starts - first[row]).astype(np.int32)),
                    ],
                    names=["hash", "check", "doc", "at"],
                )

    joined = _keyed(documents).join(places, "doc")
    return joined.select("doc", "text", "ats").mapInArrow(read, "hash long, check int, doc long, at int")


def _in_several(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows of two or more documents: keys and the first document."""
    return windows.groupBy(*keys).agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select(*keys, "first")


def repeated_windows(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, hashes): per document, hashes of its windows that start in an earlier document too."""
    lengths = levels(window)
    if len(lengths) == 1:
        raise ValueError("the window is too short for two levels")
    found = first_level(documents, window, lengths[0])
    keys = ["hash"]
    for inner, outer in zip(lengths, lengths[1:]):
        several = stash(_in_several(found, keys), f"repeats-{inner}")
        survivors = found.select(*keys, "doc", "at").join(several.select(*keys), keys, "left_semi")
        # A document's list is no longer than the document.
        places = stash(survivors.groupBy("doc").agg(F.collect_list("at").alias("ats")), f"places-{inner}")
        found, keys = stash(extended(documents, places, inner, outer, stand=len(lengths) == 2), f"windows-{outer}"), ["hash", "check"]
    several = stash(_in_several(found, keys), f"repeats-{window}")
    later = found.select(*keys, "doc").join(several, keys).where("doc > first")
    return stash(later.groupBy("doc").agg(F.collect_list("hash").alias("hashes")), "later-windows")


def substring_dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut out of ``text``; adds n_words (before) and n_removed.

    A cut takes each removed word with the white space after it; a text that loses nothing stays as it is.
    """
    columns = [c for c in documents.columns if c not in ("n_words", "n_removed")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column("__hashes")
            out, totals, gone = [], [], []
            for low, high, data, offsets in W.text_slices(texts):
                words = W.find_words(data, offsets)
                own = W.hash_spans(data, words.starts, words.ends)
                count = np.bincount(words.row, minlength=high - low)
                first = np.cumsum(count) - count
                removed = np.zeros(len(own) + 1, np.int64)
                for k in range(high - low):
                    if lists[low + k].is_valid and count[k] >= window:
                        mine = W.window_hashes(own[first[k] : first[k] + count[k]], window)
                        starts = first[k] + np.flatnonzero(np.isin(mine, lists[low + k].values.to_numpy().view(np.uint64)))
                        removed[starts] += 1
                        removed[starts + window] -= 1
                removed = np.cumsum(removed[:-1]) > 0
                lost = np.bincount(words.row[removed], minlength=high - low)
                totals.append(count)
                gone.append(lost)
                for k in range(high - low):
                    if not lost[k]:
                        out.append(texts[low + k])
                        continue
                    span = np.s_[first[k] : first[k] + count[k]]
                    begin, end = words.starts[span], np.append(words.starts[span][1:], words.ends[span][-1])
                    keep = np.ones(offsets[k + 1] - offsets[k], bool)
                    drop = removed[span]
                    keep[W.gather(np.arange(len(data)), begin[drop], (end - begin)[drop]) - offsets[k]] = False
                    out.append(pa.scalar(data[offsets[k] : offsets[k + 1]][keep].tobytes().decode(), pa.string()))
            new = {"text": pa.array([x.as_py() for x in out], pa.string())}
            whole = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (totals, gone)]
            yield pa.RecordBatch.from_arrays(
                [new.get(c, batch.column(c)) for c in columns] + [pa.array(x.astype(np.int64)) for x in whole], names=[*columns, "n_words", "n_removed"]
            )

    later = repeated_windows(documents, window).select(F.col("doc").alias("__doc"), F.col("hashes").alias("__hashes"))
    joined = documents.select(*columns).join(later, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("__doc"), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*columns).schema.fields)
    return joined.select(*columns, "__hashes").mapInArrow(cut, f"{schema}, n_words long, n_removed long")
