"""Exact join of near-identical texts on their sets of 5-word shingles, with signature trees.

Two texts link when ``100 * shared >= percent * all`` of their distinct shingles (A-Z lower-cased).  Linked texts share
one of the first ``n - ceil(percent * n / 100) + 1`` shingles of either in any fixed order; frequent shingles come last
in the order used here, so a passage that many documents hold leads few of them into one bucket.

1. Texts with equal sets are one node.  Nodes meet in the buckets of their first shingles.
2. Each bucket's smallest node is compared with the others of the bucket; verified links give first components.
3. In buckets where several components are left, ``LEADERS`` other nodes are compared with those of other components.
   A large group of near copies thus grows together before any of its pairs are listed.
4. In buckets where several components are still left, a signature tree is walked against itself: its nodes hold bitmaps
   combined by OR (shingles some text below has) and by AND (those every text below has) and a range of set sizes.
   A pair of tree nodes is dropped when the largest possible overlap is too small or both lie in one component.
   The first walk has components as leaves, the second the texts of component pairs that are left, with bitmaps of
   their buckets too: linked texts share not one first shingle but many.  A pair leaves the first of its buckets alone.
   What remains is verified and joined to the components.

So no pair inside a known component is ever formed, and a group of copies costs one comparison a copy.  A bucket with
over ``BLOCK`` leaves is cut into blocks, and pairs of blocks are walked on their own.

Cases: null texts and texts without words have no shingles and link with nothing; texts under five words have one
shingle; a null doc_id is the last choice for a component's id; repeated rows get the same component; an empty table
gives no rows; other columns are ignored.  Sets and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrid.llm import words as W
from pressgrid.llm.graph import components
from pressgrid.llm.store import discard, join_grouped, passing_tables, stash

SHINGLE = 5
PERCENT = 80
LONGS = 16  # 64-bit words of a bitmap
BLOCK = 2048
FANOUT = 8
#: Shingles in over 1/HEAVY of a block's texts are noted; those in over 1/HEAVY of all texts number at most HEAVY times
#: the mean set size, whatever the number of texts.
HEAVY = 1000
BLOCK_SHINGLES = 1 << 21
LAST = (1 << 63) - 1
BITS = [f"s{k}" for k in range(LONGS)]
MET = [f"t{k}" for k in range(LONGS)]  # the bitmap of a text's buckets
LEADERS = 3  # more of a bucket, each the smallest node in another order
CARRIED = 16  # buckets, the first ones, that a leaf knows of itself in a walk


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row and hash."""
    words = W.find_words(data, offsets)
    hashes = W.hash_spans(W.lower_table()[data], words.starts, words.ends)
    at = W.window_starts(words, size)
    rows, found = [words.row[at]], [W.window_hashes(hashes, size)[at]]
    count = np.bincount(words.row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    for few in range(1, size):  # whole short texts; the length is part of the hash
        short = np.flatnonzero(count == few)
        if len(short):
            rows.append(short)
            found.append(W.window_hashes(hashes, few, 100 + few)[first[short]])
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = _by_row_and_hash(rows, found)
    rows, found = rows[order], found[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    return rows[new], found[new]


def _by_row_and_hash(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order by row and hash: by one packed key where its bits suffice."""
    bits = np.uint64(max(1, int(rows.max()).bit_length()) if len(rows) else 1)
    packed = (rows.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(packed)
    packed, sorted_ = packed[order], hashes[order]
    if ((packed[1:] == packed[:-1]) & (sorted_[1:] != sorted_[:-1])).any():
        return np.lexsort((hashes, rows))
    return order


def set_keys(rows: np.ndarray, shingles: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(set size, 64-bit key of the set) per row."""
    n = np.bincount(rows, minlength=count)
    total, crossed = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        begin = (np.cumsum(n) - n)[full]
        total[full] = np.add.reduceat(W.mix(shingles), begin)
        crossed[full] = np.bitwise_xor.reduceat(W.mix(shingles + np.uint64(77)), begin)
    return n, W.mix(total + W.mix(crossed) + n.astype(np.uint64))


def bitmaps(rows: np.ndarray, shingles: np.ndarray, count: int) -> np.ndarray:
    """One bitmap per row, ``LONGS`` words each."""
    bits = np.zeros((count, LONGS * 64), bool)
    bits[rows, (shingles >> np.uint64(54)).astype(np.int64)] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def _sliced(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    for batch in batches:
        for low, high, data, offsets in W.text_slices(batch.column("text")):
            yield batch, low, high, *shingle_sets(data, offsets, size)


def text_sets(documents: DataFrame, size: int = SHINGLE) -> DataFrame:
    """A row per text (doc_id, node, n, bitmap), and rows (token, texts) for the shingles frequent in a block of texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts = [], 0

        def frequent() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(held), return_counts=True)
            often = (times >= 2) & (times * HEAVY >= texts)
            return made([None] * often.sum(), [None] * often.sum(), [None] * often.sum(), None, tokens[often].view(np.int64), times[often])

        def made(ids, nodes, n, maps, tokens, times) -> pa.RecordBatch:
            count = len(nodes)
            bits = [pa.array(maps[:, k]) if maps is not None else pa.nulls(count, pa.int64()) for k in range(LONGS)]
            rest = [pa.array(x, pa.int64()) if x is not None else pa.nulls(count, pa.int64()) for x in (tokens, times)]
            ids = ids if isinstance(ids, pa.Array) else pa.array(ids, pa.int64())
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), *bits, *rest], names=["doc_id", "node", "n", *BITS, "token", "texts"]
            )

        for batch, low, high, rows, shingles in _sliced(batches, size):
            n, keys = set_keys(rows, shingles, high - low)
            ids = batch.column("doc_id").slice(low, high - low)
            yield made(ids, keys.view(np.int64), n, bitmaps(rows, shingles, high - low), None, None)
            held.append(shingles)
            texts += high - low
            if sum(map(len, held)) >= BLOCK_SHINGLES:
                yield frequent()
                held, texts = [], 0
        if held:
            yield frequent()

    schema = "doc_id long, node long, n long, " + ", ".join(f"{b} long" for b in BITS) + ", token long, texts long"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, schema)


def first_shingles(documents: DataFrame, heavy: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, node): the shingles of which linked texts must share one."""
    shared = documents.sparkSession.sparkContext.broadcast(heavy)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for _, low, high, rows, shingles in _sliced(batches, size):
            n, keys = set_keys(rows, shingles, high - low)
            at = np.minimum(np.searchsorted(known, shingles), max(0, len(known) - 1))
            late = known[at] == shingles if len(known) else np.zeros(len(shingles), bool)
            order = np.argsort(2 * rows + late, kind="stable")  # by hash within
            rows, shingles = rows[order], shingles[order]
            place = np.arange(len(rows)) - (np.cumsum(n) - n)[rows]
            take = place < (n - (percent * n + 99) // 100 + 1)[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingles[take].view(np.int64)), pa.array(keys.view(np.int64)[rows[take]])], names=["token", "node"]
            )

    return documents.select("text").mapInArrow(read, "token long, node long")


# --- signature trees ---------------------------------------------------------------


def _ones(maps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(maps.view(np.uint64)).sum(axis=-1).astype(np.int64)  # of signed values numpy counts the absolute ones


class Level:
    """Nodes of one height: OR and AND bitmaps, size range, component (0 where several meet)."""

    def __init__(self, some: np.ndarray, every: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray):
        self.some, self.every, self.low, self.high, self.group = some, every, low, high, group

    def above(self) -> Level:
        begin = np.arange(0, len(self.low), FANOUT)
        low_group, high_group = np.minimum.reduceat(self.group, begin), np.maximum.reduceat(self.group, begin)
        return Level(
            np.bitwise_or.reduceat(self.some, begin),
            np.bitwise_and.reduceat(self.every, begin),
            np.minimum.reduceat(self.low, begin),
            np.maximum.reduceat(self.high, begin),
            np.where(low_group == high_group, low_group, -1),
        )

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        most = np.minimum(
            self.high[i] - _ones(self.every[i] & ~self.some[j]), self.high[j] - _ones(self.every[j] & ~self.some[i])
        )
        return (
            ((100 + percent) * most >= percent * (self.low[i] + self.low[j]))
            & (100 * self.high[i] >= percent * self.low[j])
            & (100 * self.high[j] >= percent * self.low[i])
            & ((self.group[i] != self.group[j]) | (self.group[i] < 0))
        )


def tree_pairs(leaves: Level, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of different components that the bounds can't rule out, by a dual walk from the root."""
    levels = [leaves]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].above())
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    child = np.arange(FANOUT)
    for level in reversed(levels[:-1]):
        count = len(level.low)
        found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for part in range(0, len(i), 1024):
            a = (i[part : part + 1024, None, None] * FANOUT + child[None, :, None]).repeat(FANOUT, axis=2).ravel()
            b = (j[part : part + 1024, None, None] * FANOUT + child[None, None, :]).repeat(FANOUT, axis=1).ravel()
            fit = (a < count) & (b < count) & ((a < b) if level is leaves else (a <= b))
            a, b = a[fit], b[fit]
            keep = level.may_link(a, b, percent)
            if level is not leaves:
                keep |= (a == b) & (level.group[a] < 0)
            found_i.append(a[keep])
            found_j.append(b[keep])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
    if len(levels) == 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return i, j


def _walk_buckets(members: DataFrame, leaves: DataFrame, percent: int) -> DataFrame:
    """(a, b, a_n, b_n) of distinct members of one bucket that may link; ``a_n`` and ``b_n`` are their ``low``.

    members: bucket, id.  leaves: id, root, low, high, and the bitmaps ``o*`` (OR) and ``e*`` (AND); leaves that are texts
    may have ``m`` and ``t*`` (see ``bucket_bitmaps``) for a bound on the buckets that hold both.
    """
    with passing_tables(members.sparkSession) as keep:
        return keep(_walked(members, leaves, percent), "walked-pairs")


def _walked(members: DataFrame, leaves: DataFrame, percent: int) -> DataFrame:
    some, every = [f"o{k}" for k in range(LONGS)], [f"e{k}" for k in range(LONGS)]
    texts = ["m", *MET] if "m" in leaves.columns else []

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            found, count = [], 0
            key = frame[["bucket", "part"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            ids, own, carried = frame["id"].to_numpy(), frame["own"].to_numpy(), np.stack(frame["carried"].to_numpy())
            maps = frame[some].to_numpy(), frame[every].to_numpy()
            met = (frame["m"].to_numpy(), frame[MET].to_numpy()) if texts else None
            low, high = frame["low"].to_numpy(), frame["high"].to_numpy()
            _, root = np.unique(frame["root"].to_numpy(), return_inverse=True)
            for begin, end in zip(np.concatenate(([0], cut)), np.append(cut, len(frame))):
                if end - begin > 1:
                    at = begin + np.lexsort((ids[begin:end], low[begin:end]))
                    i, j = (at[x] for x in tree_pairs(Level(maps[0][at], maps[1][at], low[at], high[at], root[at]), percent))
                    bucket, part = key[begin]
                    if part // PARTS != part % PARTS:  # members of one block meet in a part of their own
                        i, j = i[own[i] != own[j]], j[own[i] != own[j]]
                    if met:
                        fit = may_share(*met, low, i, j, percent)
                        i, j = i[fit], j[fit]
                    first = ~met_before(carried, i, j, bucket)
                    found.append((i[first], j[first]))
                    count += len(found[-1][0])
                if count and (count >= HELD_PAIRS or end == len(frame)):
                    i, j = (np.concatenate(x) for x in zip(*found))
                    yield pd.DataFrame({"a": ids[i], "b": ids[j], "a_n": low[i], "b_n": low[j]})
                    found, count = [], 0

        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            last = frame[["bucket", "part"]].iloc[-1]
            open_ = (frame["bucket"] == last["bucket"]) & (frame["part"] == last["part"])
            rest = frame[open_]
            if not open_.all():
                yield from pairs(frame[~open_])
        if rest is not None and len(rest):
            yield from pairs(rest)

    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("id") % 1000003).alias("one"), F.bit_xor(F.xxhash64("id")).alias("two"))
    # Buckets with the same members say the same: one of them is walked.
    kept = sizes.groupBy("size", "one", "two").agg(F.min("bucket").alias("bucket"))
    dealt = members.join(kept.select("bucket", "size"), "bucket")
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("id"), blocks)
    dealt = stash(dealt.select("bucket", "id", blocks.alias("blocks"), own.alias("own")), "bucket-members")
    by_bucket = Window.partitionBy("id").orderBy("bucket")
    carried = dealt.select("id", "bucket", F.row_number().over(by_bucket).alias("place")).where(F.col("place") <= CARRIED)
    carried = carried.groupBy("id").agg(F.collect_list("bucket").alias("carried"))
    filled = F.concat(F.sort_array("carried"), F.array_repeat(F.lit(LAST), CARRIED - F.size("carried")))
    leaves = leaves.join(carried.select("id", filled.alias("carried")), "id")
    part = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.least(k, F.col("own")) * PARTS + F.greatest(k, F.col("own")))
    parts = dealt.select("bucket", "id", "own", F.explode(F.when(F.col("blocks") > 1, part).otherwise(F.array(F.lit(0).cast("long")))).alias("part"))
    # Bitmaps come last, so they cross one exchange only.
    rows = parts.join(leaves, "id").select("bucket", "part", "id", "own", "root", "low", "high", "carried", *some, *every, *texts)
    met = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInPandas(walk, "a long, b long, a_n long, b_n long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"), F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n")).distinct()


#: Parts of a bucket are numbered first block * PARTS + second block.
PARTS = 1000000


def met_before(carried: np.ndarray, i: np.ndarray, j: np.ndarray, bucket: int) -> np.ndarray:
    """Whether leaves i and j know of an earlier bucket with both.  No pair passes in none: its first bucket has no earlier one."""
    before = np.zeros(len(i), bool)
    for low in range(0, len(i), 4096):
        one, two = carried[i[low : low + 4096]], carried[j[low : low + 4096]]
        before[low : low + 4096] = ((one[:, :, None] == two[:, None, :]) & (one < bucket)[:, :, None]).any(axis=(1, 2))
    return before


def may_share(m: np.ndarray, met: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether texts i and j may meet in as many buckets as linked texts of their sizes ``n`` must (``must_share``)."""
    most = np.minimum(m[i] - _ones(met[i] & ~met[j]), m[j] - _ones(met[j] & ~met[i]))
    common = (percent * (n[i] + n[j]) + 99 + percent) // (100 + percent)
    return most >= common - (percent * np.maximum(n[i], n[j]) + 99) // 100 + 1


def must_share(percent: int) -> Column:
    """In how many buckets linked texts of the sizes ``a_n`` and ``b_n`` meet at least.

    Linked texts have ``o = ceil(percent * (a_n + b_n) / (100 + percent))`` shingles in common or more.  Say the first
    shingles of a end no later than those of b.  At most ``a_n - o`` of them are not in b, and the others are among b's
    first ones; a text's first shingles number ``n - ceil(percent * n / 100) + 1``.
    """
    common = F.expr(f"({percent} * (a_n + b_n) + {99 + percent}) div {100 + percent}")
    return common - F.expr(f"({percent} * greatest(a_n, b_n) + 99) div 100") + 1


def bucket_bitmaps(mixed: DataFrame) -> DataFrame:
    """node, m (its buckets in ``mixed``), and their bitmap ``t*``; texts of different components meet in no others."""
    place = F.xxhash64("token").bitwiseAND(F.lit(64 * LONGS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    own = [F.bit_or(F.when(F.shiftright("place", 6) == k, bit).otherwise(F.lit(0).cast("long"))).alias(t) for k, t in enumerate(MET)]
    return mixed.select("node", place.alias("place")).groupBy("node").agg(F.count(F.lit(1)).alias("m"), *own)


# --- verification -------------------------------------------------------------------


def _ones_of(one: str, two: str) -> Column:
    """Bits of the bitmap ``one`` that ``two`` lacks."""
    return sum((F.bit_count(F.col(f"{one}{k}").bitwiseAND(F.bitwise_not(f"{two}{k}"))) for k in range(LONGS)), F.lit(0))


def _may_link(a: str, b: str, percent: int) -> Column:
    """The leaf bound as a column: bitmaps and sizes of sides ``a`` and ``b``."""
    ones = _ones_of
    most = F.least(F.col(f"{a}n") - ones(a, b), F.col(f"{b}n") - ones(b, a))
    return ((100 + percent) * most >= percent * (F.col(f"{a}n") + F.col(f"{b}n"))) & (
        100 * F.least(f"{a}n", f"{b}n") >= percent * F.greatest(f"{a}n", f"{b}n")
    )


def with_near_bitmaps(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps and sizes allow a link, with the sizes ``a_n`` and ``b_n``."""
    sides = pairs
    for side in ("a", "b"):
        own = nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), *(F.col(s).alias(f"{side}_{k}") for k, s in enumerate(BITS)))
        sides = sides.join(own, side)
    return sides.where(_may_link("a_", "b_", percent)).select(*pairs.columns, "a_n", "b_n")


def led_again(documents: DataFrame, nodes: DataFrame, mixed: DataFrame, size: int, percent: int) -> DataFrame:
    """The links of each bucket's other leaders with the bucket's nodes of other components.

    nodes: node, root, n, m and both bitmaps.  mixed: token, node, root.
    """
    masks = W.mix(np.arange(1, LEADERS + 1, dtype=np.uint64)).view(np.int64).tolist()
    least = mixed.groupBy("token").agg(*(F.min(F.col("node").bitwiseXOR(F.lit(x))).alias(f"least{k}") for k, x in enumerate(masks)))
    back = [F.col(f"least{k}").bitwiseXOR(F.lit(x)) for k, x in enumerate(masks)]
    leads = least.select("token", F.array_distinct(F.array(*back)).alias("leads"))
    pairs = mixed.join(leads, "token").select(F.explode("leads").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    for side in ("a", "b"):
        maps = [F.col(c).alias(f"{side}_{k}") for k, c in enumerate(BITS)] + [F.col(c).alias(f"{side}_{c}") for c in MET]
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("root", "n", "m")), *maps), side)
    meet = F.least(F.col("a_m") - _ones_of("a_t", "b_t"), F.col("b_m") - _ones_of("b_t", "a_t"))
    near = pairs.where("a_root <> b_root").where(_may_link("a_", "b_", percent) & (meet >= must_share(percent)))
    near = near.select("a", "b", "a_n", "b_n", F.col("a").alias("group_a"), F.lit(0).cast("long").alias("group_b"))
    return verified(documents, nodes, near, size, percent)


def verified(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, by their whole sets.

    pairs: a, b, their set sizes ``a_n`` and ``b_n``, and ``group_a`` and ``group_b``, which name pairs that share texts.
    """
    with passing_tables(documents.sparkSession) as keep:
        return keep(_verified(documents, nodes, pairs, size, percent), "links")


def _verified(documents: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    open_ = stash(pairs.select("a", "b", "a_n", "b_n", "group_a", "group_b"), "open-pairs")
    wanted = open_.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = wanted.join(nodes.select("node", "doc"), "node")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                _, own = set_keys(*shingle_sets(data, offsets, size), high - low)
                right = np.flatnonzero(own.view(np.int64) == batch.column("node").to_numpy()[low:high])
                small = [pack(data[offsets[k] : offsets[k + 1]].tobytes()) for k in right]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)[right]), pa.array(small, pa.binary())], names=["node", "small"])

    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text").join(keys.hint("merge"), "doc")
    # Rows that share a doc_id may hold other sets; only the node's own passes, once.
    small = stash(texts.select("text", "node").mapInArrow(squeeze, "node long, small binary").groupBy("node").agg(F.first("small").alias("small")), "pair-texts")

    # A cell holds pairs that share texts, and each text once: what crosses the network grows with the texts, not the pairs.
    celled = _cells(open_)
    texts_in = celled.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct().join(small, "node")
    rows = texts_in.select("cell", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(0).cast("long").alias("b"), "small").unionByName(
        celled.select("cell", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("small"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, texts, a, b, held = None, CellTexts(size), [], [], 0

        def links() -> pa.RecordBatch:
            one, two = np.concatenate(a), np.concatenate(b)
            link = texts.linked(one, two, percent)
            return pa.RecordBatch.from_arrays([pa.array(one[link]), pa.array(two[link])], names=["a", "b"])

        for batch in batches:
            of, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(of)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if of[low] != cell:
                    if held:
                        yield links()
                    cell, texts, a, b, held = of[low], CellTexts(size), [], [], 0
                part = batch.slice(low, high - low)
                if kind[low] == 0:
                    texts.add(part.column("a").to_numpy(), part.column("small"))
                    continue
                a.append(part.column("a").to_numpy())
                b.append(part.column("b").to_numpy())
                held += high - low
                if held >= HELD_PAIRS:
                    yield links()
                    a, b, held = [], [], 0
        if held:
            yield links()

    celled_rows = stash(rows, "pair-cells")
    discard(open_, small)
    dealt = celled_rows.repartition("cell").sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(compare, "a long, b long")


#: Shingles of a cell's texts on either side, about: 16 MB of hashes.
CELL_SHINGLES = 1 << 21
#: Pairs that a task holds at a time, however many its cell or bucket has.
HELD_PAIRS = 1 << 20


def _cells(pairs: DataFrame) -> DataFrame:
    """(cell, a, b): pairs dealt to cells of about ``CELL_SHINGLES`` shingles on either side.

    ``group_a`` and ``group_b`` name pairs that share texts; large groups are cut on both sides.
    """
    groups = ["group_a", "group_b"]
    weight = lambda c: (F.count_distinct(c) * F.avg(f"{c}_n")).alias(f"weight_{c}")
    sizes = pairs.groupBy(*groups).agg(weight("a"), weight("b"))
    part = lambda c: F.pmod(F.xxhash64(c), F.ceil(F.col(f"weight_{c}") / CELL_SHINGLES))
    return pairs.join(sizes, groups).select(F.xxhash64(*groups, part("a"), part("b")).alias("cell"), "a", "b")


class CellTexts:
    """Shingle sets of a cell's texts, by node."""

    def __init__(self, size: int):
        self.size, self.nodes, self.counts, self.shingles, self.whole = size, [], [], [], None

    def add(self, nodes: np.ndarray, packed: pa.Array) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        parts, held = [], 0
        self.nodes.append(nodes)
        for k, one in enumerate(packed, 1):
            parts.append(unpack(one.as_buffer()))
            held += len(parts[-1])
            if k == len(packed) or len(parts) == 64 or held >= W.SLICE_BYTES:
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
                rows, found = shingle_sets(np.frombuffer(b"".join(parts), np.uint8), offsets, self.size)
                self.counts.append(np.bincount(rows, minlength=len(parts)))
                self.shingles.append(found)
                parts, held = [], 0

    def linked(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether the sets of the nodes a and b link; no text is added after."""
        if self.whole is None:
            nodes = np.concatenate(self.nodes)
            order = np.argsort(nodes)
            self.whole = nodes[order], order, np.concatenate(self.shingles), np.concatenate(self.counts)
            self.nodes, self.shingles, self.counts = [], [], []
        nodes, order, shingles, n = self.whole
        return linked(shingles, n, order[np.searchsorted(nodes, a)], order[np.searchsorted(nodes, b)], percent)


def linked(shingles: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets of rows a and b link.  Bitmaps rule most pairs out; the rest are intersected.

    Bitmaps are made for the pairs of one size class at a time, about a byte per shingle, so one long text does not widen
    those of short ones.
    """
    link = np.zeros(len(a), bool)
    begin = np.cumsum(n) - n
    largest = np.maximum(n[a], n[b])
    near = 100 * np.minimum(n[a], n[b]) >= percent * largest
    size_class = np.where(near, np.frexp(largest)[1], -1)
    for k in np.unique(size_class[near]):
        asked = np.flatnonzero(size_class == k)
        nodes = np.unique(np.concatenate([a[asked], b[asked]]))
        place = np.full(len(n), -1)
        place[nodes] = np.arange(len(nodes))
        bits = 1 << max(9, 3 + int(k))
        maps = np.zeros((len(nodes), bits // 64), np.uint64)
        own = W.gather(shingles, begin[nodes], n[nodes])
        at = (own >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
        np.bitwise_or.at(maps, (np.repeat(np.arange(len(nodes)), n[nodes]), at // 64), np.uint64(1) << (at % 64).astype(np.uint64))
        step = max(1, (1 << 19) // maps.shape[1])
        for low in range(0, len(asked), step):
            some = asked[low : low + step]
            i, j = place[a[some]], place[b[some]]
            of_i, of_j = n[a[some]], n[b[some]]
            most = np.minimum(of_i - _ones(maps[i] & ~maps[j]), of_j - _ones(maps[j] & ~maps[i]))
            link[some] = (100 + percent) * most >= percent * (of_i + of_j)
    for k in np.flatnonzero(link):
        i, j = a[k], b[k]
        shared = len(np.intersect1d(shingles[begin[i] : begin[i] + n[i]], shingles[begin[j] : begin[j] + n[j]], assume_unique=True))
        link[k] = 100 * shared >= percent * (n[i] + n[j] - shared)
    return link


# --- the join -----------------------------------------------------------------------


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, node, root) of the buckets that hold several components; the written table ``members`` ends here."""
    placed = stash(_rooted(members.select("token", "node"), roots).select("token", "node", "root"), "placed")
    discard(members)
    mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("token")
    mixed = stash(placed.join(mixed, "token", "left_semi"), "mixed")
    discard(placed)
    return mixed


def jaccard_components(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; links are exact."""
    with passing_tables(documents.sparkSession) as keep:
        return keep(_components_of(documents, size, percent), "document-components")


def _components_of(documents: DataFrame, size: int, percent: int) -> DataFrame:
    found = stash(text_sets(documents, size), "text-sets")
    rows = found.where("node is not null").select("doc_id", "node", "n", *BITS)
    total = rows.count()
    often = found.where("token is not null").groupBy("token").agg(F.sum("texts").alias("texts")).where(F.col("texts") * HEAVY >= total)
    heavy = np.sort(np.array(often.select("token").toArrow().column(0), np.int64).view(np.uint64))
    first_of = [F.first(b).alias(b) for b in BITS]
    nodes = stash(
        rows.where("n > 0").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("doc"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), *first_of),
        "nodes",
    )

    tokens = stash(first_shingles(documents, heavy, size, percent), "first-shingles")
    leads = stash(
        tokens.groupBy("token").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("token", "lead"), "leads"
    )
    members = stash(tokens.join(leads, "token").distinct(), "members")
    discard(tokens, leads)
    stars = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.withColumn("group_a", F.col("a")).withColumn("group_b", F.lit(0).cast("long"))
    links = verified(documents, nodes, with_near_bitmaps(stars, nodes, percent), size, percent)
    roots = components(links)

    # Buckets that still hold several components.
    mixed = _mixed(members, roots)
    met = stash(nodes.join(bucket_bitmaps(mixed), "node").select("node", "doc", "n", "m", *BITS, *MET), "met-nodes")
    more = led_again(documents, _rooted(met, roots), mixed, size, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links)
        mixed = _mixed(mixed, roots)
    leaf = _rooted(nodes, roots)
    united = leaf.groupBy("root").agg(
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        *(F.bit_or(b).alias(f"o{k}") for k, b in enumerate(BITS)),
        *(F.bit_and(b).alias(f"e{k}") for k, b in enumerate(BITS)),
    )
    united = united.withColumn("id", F.col("root"))
    of_roots = stash(mixed.select(F.col("token").alias("bucket"), F.col("root").alias("id")).distinct(), "bucket-roots")
    near = _walk_buckets(of_roots, united, percent)
    discard(of_roots)
    if not near.isEmpty():
        some = near.select(F.explode(F.array("a", "b")).alias("root")).distinct()
        single = _rooted(met, roots).select(
            F.col("node").alias("id"), "root", F.col("n").alias("low"), F.col("n").alias("high"), "m", *MET,
            *(F.col(b).alias(f"{c}{k}") for c in "oe" for k, b in enumerate(BITS)),
        )
        of_nodes = stash(mixed.join(some, "root", "left_semi").select(F.col("token").alias("bucket"), F.col("node").alias("id")), "bucket-nodes")
        discard(mixed, near)
        walked = _walk_buckets(of_nodes, single, percent)
        pairs = stash(walked, "node-pairs")
        discard(of_nodes, walked)
        # Texts that nearly link form clusters of pairs; cells cut each cluster into a grid.
        cluster = components(pairs).select(F.col("node").alias("a"), F.col("root").alias("group_a"))
        pairs = pairs.join(cluster, "a").withColumn("group_b", F.lit(0).cast("long"))
        more = verified(documents, nodes, pairs, size, percent)
        if not more.isEmpty():
            roots = components(links.unionByName(more))

    joined = nodes.join(roots, "node", "left").select("node", "doc", "size", F.coalesce("root", "node").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("doc").alias("first"))
    classes = stash(joined.join(smallest, "root").select("node", "size", "first"), "classes")
    with_set = join_grouped(rows.where("n > 0").select("doc_id", "node", "n"), classes, ["node"], "size", total)
    component = F.when(F.col("first") < LAST, F.col("first"))
    return with_set.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).unionByName(
        rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def one_of_each(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without those linked, directly or by others, to a smaller doc_id.

    Texts without words and rows without a doc_id all stay; rows that share a doc_id go together.
    """
    found = jaccard_components(documents, size, percent)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
