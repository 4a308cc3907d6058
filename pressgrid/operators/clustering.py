"""Exact nearest-predecessor clustering of articles into stories.

Articles are taken in order: those already in a story first, then the batch by
(published_at, article_id).  Each batch article looks for the most similar
article before it that was published inside the lookback window.  At or above
the threshold it joins that article's story, else it starts one.  Since the
choice of neighbour never depends on earlier choices, every article has one
parent, stories are the roots of the forest, and the whole batch can be solved
set-wise.

Shape of the computation:

1. Equal vectors fall into one group (partial aggregation, so a mass of copies
   shrinks before the shuffle).  Only the earliest candidate of a group can be
   anybody's nearest predecessor in it, ties going to the lowest order.
2. Distinct vectors are compared exactly, but only where a bound leaves a chance.  Candidates are put into cells: the
   pivot (a distinct vector of the table) nearest by angle, and a slice of the processing order, those already
   clustered being the first slice.  A cell knows the largest positive and negative weight of its vectors in each
   dimension, the range of their angles to every pivot, and their supports.  A query meets a cell only if
   - the cell's slice is not after its own,
   - the products of its weights with the cell's largest ones reach the threshold (the bound of an inverted index over
     dimensions with maximum weights; a cell with no weight where the query has its own is never met),
   - its angle to each pivot differs from the cell's range by no more than the threshold's angle (triangle inequality),
   - neither has fewer non-zero components than the other demands.
   Cells of a slice are put together into blocks, and a vector travels by block, not by cell: a query goes once to each
   block that holds one of its cells, with a bit for each cell, and a block's candidates go to as many tasks as share
   its queries.  There are at most ``MAX_BLOCKS`` blocks and a few more by slice, so what crosses the network grows with the vectors.  A task
   holds one block and streams the queries.  The block finds the axes along which its vectors lie most.  What two vectors
   have along the first axes and the lengths of what is left bound their similarity (Cauchy-Schwarz), so a query is held
   against all candidates by few components, then against the tiles whose bound reaches the threshold and its best so far
   by more, and only what is left by whole vectors.  Products run in single precision with numpy, and whatever comes
   within ``SLOP`` of the best is taken again in double precision.  A block returns at most one best partner per query
   and question, and only the questions that a query's articles ask; pairs are never emitted.
3. Roots come from pointer jumping over one node per distinct vector.

Similarities are rounded to 6 places, as stored vectors carry that precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pressgrid import constants as C
from pressgrid.functions.vectors import cosine_similarity
from pressgrid.operators.dashboards import since
from pressgrid.session import cut_lineage
from pressgrid.stash import passing_tables, stash

BLOCK_ROWS = 65536  # candidates of a block: 100 MB at 384 dimensions; more only where blocks are at their most
MAX_BLOCKS = 32
TASKS = 32  # blocks are shared between tasks until there are about so many
QUERY_ROWS = 4096  # queries a task should have at least
CELL_ROWS = 4096  # vectors a cell should hold; many more only where cells are at their most
MAX_PIVOTS, MAX_SLICES = 128, 4  # bound what describes the cells, whatever the number of vectors
QUERY_SLICE, CANDIDATE_TILES = 256, 32  # rows and tiles of one product: 4 MB
TILE_ROWS = 128  # candidates that a query meets or passes by together
RUN_ROWS = 1024  # candidates of a cell in order, from which tiles are made
AXES = (15, 127)  # axes by which bounds are taken, one after the other
AXIS_ROWS = 8192  # vectors to find the axes by; bounds hold with any
CHUNK = 8192  # vectors turned at once
ROUNDING = 4e-6  # over what single precision may lose of a unit vector's square
DIGITS = 6
SLOP = 1e-4  # over twice what single precision and rounding can differ by
EXACT_PAIRS = 8192  # rows compared at once in double precision: 25 MB a side
EARLIER, EXISTING = 0, 1  # the two questions a query vector asks
GROUP = ["h1", "h2"]
ORDER_TYPE = "struct<in_batch:int,at:bigint,article_id:bigint,story_id:bigint>"


def pairwise_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Similarity of the two vector columns of each row."""
    return pairs.withColumn("similarity", F.round(cosine_similarity(F.col(a), F.col(b)), DIGITS))


def _unit(vectors: pd.Series) -> np.ndarray:
    grid = np.stack(vectors.to_numpy()).astype(np.float64)
    return grid / np.sqrt((grid * grid).sum(axis=1, keepdims=True))


def _demands(unit: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of non-zero components, and how many a partner must have to reach the threshold."""
    squares = unit * unit
    cumulative = np.cumsum(-np.sort(-squares, axis=1), axis=1)
    return (squares > 0).sum(axis=1), (cumulative < floor * floor * (1 - 1e-9)).sum(axis=1) + 1


def _members(articles: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """Articles with a vector: group hash, order, and whether they may be a predecessor."""
    return articles.where(F.col("embedding").isNotNull()).select(
        "article_id",
        F.xxhash64("embedding").alias("h1"),
        F.xxhash64(F.lit("second"), F.col("embedding")).alias("h2"),
        F.struct(
            F.when(F.col("story_id").isNull(), 1).otherwise(0).alias("in_batch"),
            F.unix_micros("published_at").alias("at"),
            F.col("article_id").cast("long").alias("article_id"),
            F.col("story_id").cast("long").alias("story_id"),
        ).alias("place"),
        (F.col("published_at") >= since(as_of, days=lookback_days)).alias("is_candidate"),
        F.exists("embedding", lambda x: x != 0).alias("has_length"),
        "embedding",
    )


def _groups(members: DataFrame) -> DataFrame:
    """One row per distinct vector: earliest candidate, whether the batch asks for it and which questions, vector."""
    in_batch = F.col("place.in_batch") == 1
    asks = lambda kind, of: F.shiftleft(F.coalesce(F.max(in_batch & of), F.lit(False)).cast("int"), kind)
    return members.where("has_length").groupBy(*GROUP).agg(
        F.min(F.when(F.col("is_candidate"), F.col("place"))).alias("first"),
        F.max(in_batch).alias("asks"),
        # Only an article that is no candidate itself asks for clustered ones alone (see _partner_columns).
        (asks(EARLIER, F.coalesce("is_candidate", F.lit(True))) + asks(EXISTING, ~F.col("is_candidate"))).alias("wants"),
        F.any_value("embedding").alias("embedding"),
    )


@dataclass
class Cells:
    """What is known of the candidates by cell (row ``pivot * slices + slice``); at most 128 x 4 rows."""

    pivots: np.ndarray  # unit vectors
    cuts: list[int]  # times at which the slices after the first two begin
    rows: np.ndarray
    positive: np.ndarray  # largest weight by dimension
    negative: np.ndarray  # largest absolute negative weight by dimension
    nearest: np.ndarray  # smallest angle to each pivot
    farthest: np.ndarray  # largest angle to each pivot
    support: np.ndarray  # most non-zero components
    reach: np.ndarray  # fewest components demanded of a partner

    @property
    def slices(self) -> int:
        return len(self.cuts) + 2

    def reached(self, unit: np.ndarray, in_batch: np.ndarray, at: np.ndarray, threshold: float) -> np.ndarray:
        """Queries x cells: whether a cell may hold a partner at or above the threshold."""
        floor = threshold - 10.0**-DIGITS
        support, reach = _demands(unit, floor)
        own = order_slice(in_batch, at, self.cuts)
        met = (self.rows > 0) & (np.arange(len(self.rows)) % self.slices <= own[:, None])
        met &= (self.support >= reach[:, None]) & (self.reach <= support[:, None])
        met &= np.maximum(unit, 0) @ self.positive.T + np.maximum(-unit, 0) @ self.negative.T >= floor - 1e-9
        angle, widest = _angles(unit, self.pivots), np.arccos(np.clip(floor, -1.0, 1.0)) + 1e-6
        for k in range(len(self.pivots)):
            mine = angle[:, k : k + 1]
            met &= (mine - widest <= self.farthest[:, k]) & (mine + widest >= self.nearest[:, k])
        return met


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def order_slice(in_batch: np.ndarray, at: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Slice of the processing order: 0 for clustered articles and those that are no candidates, then by time."""
    return np.where(in_batch < 1, 0, 1 + np.searchsorted(np.array(cuts, dtype=np.int64), at, side="right"))


def _flat(groups: DataFrame) -> DataFrame:
    """Integers cross into pandas without nulls, so that ids keep all their bits.

    A query without a candidate of its own sorts before everything.
    """
    return groups.select(
        *GROUP, "embedding", "wants", F.coalesce("first.in_batch", F.lit(-1)).alias("in_batch"),
        *[F.coalesce(f"first.{c}", F.lit(0).cast("long")).alias(c) for c in ("at", "article_id", "story_id")],
    )


_BOUNDS = "cell int, n long, positive array<double>, negative array<double>, nearest array<double>, farthest array<double>, support long, reach long"


def _merge_bounds(found: pd.DataFrame) -> pd.DataFrame:
    """One row from several rows of the same cell."""
    widest = {c: [np.stack(found[c]).max(axis=0)] for c in ("positive", "negative", "farthest")}
    return pd.DataFrame({
        "cell": [int(found["cell"].iloc[0])], "n": [int(found["n"].sum())], **widest, "nearest": [np.stack(found["nearest"]).min(axis=0)],
        "support": [int(found["support"].max())], "reach": [int(found["reach"].min())],
    })[[c.split()[0] for c in _BOUNDS.split(", ")]]


def _with_cell(rows: DataFrame, pivots: np.ndarray, cuts: list[int]) -> DataFrame:
    """Add the cell of each vector: its nearest pivot (the first of several) and its slice."""
    schema = "h1 long, h2 long, embedding array<float>, wants int, in_batch int, at long, article_id long, story_id long, cell int"

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                nearest = (_unit(frame["embedding"]) @ pivots.T).argmax(axis=1)
                slices = order_slice(frame["in_batch"].to_numpy(), frame["at"].to_numpy(), cuts)
                yield frame.assign(cell=(nearest * (len(cuts) + 2) + slices).astype(np.int32))

    return rows.mapInPandas(place, schema)


def _cell_bounds(candidates: DataFrame, pivots: np.ndarray, cuts: list[int], threshold: float) -> Cells:
    """Bounds of every cell: merged in each task, then by cell."""
    floor = threshold - 10.0**-DIGITS

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, pd.DataFrame] = {}
        for frame in frames:
            if not len(frame):
                continue
            unit, cells = _unit(frame["embedding"]), frame["cell"].to_numpy()
            support, reach = _demands(unit, floor)
            angle = _angles(unit, pivots)
            for cell in np.unique(cells):
                own = cells == cell
                part = pd.DataFrame({
                    "cell": [int(cell)], "n": [int(own.sum())],
                    "positive": [np.maximum(unit[own], 0).max(axis=0)], "negative": [np.maximum(-unit[own], 0).max(axis=0)],
                    "nearest": [angle[own].min(axis=0)], "farthest": [angle[own].max(axis=0)],
                    "support": [int(support[own].max())], "reach": [int(reach[own].min())],
                })
                known[int(cell)] = _merge_bounds(pd.concat([known[int(cell)], part])) if int(cell) in known else part
        yield from known.values()

    merged = candidates.mapInPandas(describe, _BOUNDS).groupBy("cell").applyInPandas(_merge_bounds, _BOUNDS)
    n_cells, dim = len(pivots) * (len(cuts) + 2), pivots.shape[1]
    cells = Cells(
        pivots, cuts, np.zeros(n_cells, dtype=np.int64), np.zeros((n_cells, dim)), np.zeros((n_cells, dim)),
        np.full((n_cells, len(pivots)), np.inf), np.full((n_cells, len(pivots)), -np.inf),
        np.zeros(n_cells, dtype=np.int64), np.full(n_cells, dim + 1, dtype=np.int64),
    )
    for r in merged.collect():  # a row per cell
        cells.rows[r.cell] = r.n
        for name in ("positive", "negative", "nearest", "farthest", "support", "reach"):
            getattr(cells, name)[r.cell] = r[name]
    return cells


def plan_cells(groups: DataFrame, threshold: float, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, Cells] | None:
    """The candidates with their cells, and the cells' bounds; None without candidates.

    Pivots are the candidates with the smallest hashes.  More candidates make more cells up to the largest number,
    then larger cells, which are dealt into blocks.
    """
    candidates = groups.where("first is not null")
    n = candidates.count()
    if n == 0:
        return None
    wanted = min(MAX_PIVOTS, -(-n // cell_rows))
    pivots = _unit(pd.Series([np.array(r.embedding, dtype=np.float64) for r in candidates.orderBy(*GROUP).limit(wanted).collect()]))
    slices = min(MAX_SLICES, -(-n // (4 * cell_rows)))
    cuts: list[int] = []
    if slices > 1:
        shares = [k / slices for k in range(1, slices)]
        times = candidates.where("first.in_batch = 1").agg(F.percentile_approx("first.at", shares).alias("cuts")).first().cuts
        cuts = sorted(set(times or []))
    placed = stash(_with_cell(_flat(candidates), pivots, cuts), "placed-vectors")
    return placed, _cell_bounds(placed, pivots, cuts, threshold)


def with_reached(queries: DataFrame, cells: Cells, threshold: float) -> DataFrame:
    """Add ``cells``, the numbers of the cells a query has to meet; queries that meet none go."""
    schema = "h1 long, h2 long, embedding array<float>, wants int, in_batch int, at long, article_id long, story_id long, cells array<int>"

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            met = cells.reached(_unit(frame["embedding"]), frame["in_batch"].to_numpy(), frame["at"].to_numpy(), threshold)
            some = met.any(axis=1)
            yield frame[some].assign(cells=[np.flatnonzero(row).astype(np.int32) for row in met[some]])

    return queries.mapInPandas(reach, schema)


@dataclass
class Blocks:
    """Which blocks the candidates of each cell lie in: ``parts`` blocks from ``first`` on; and the cells of each block."""

    first: np.ndarray
    parts: np.ndarray
    cells: list[np.ndarray]


def plan_blocks(cells: Cells, block_rows: int = BLOCK_ROWS) -> Blocks:
    """Cells of one slice fill blocks of about ``block_rows``; a larger cell is dealt over blocks of its own."""
    size = max(block_rows, -(-int(cells.rows.sum()) // MAX_BLOCKS))
    first, parts = np.zeros(len(cells.rows), dtype=np.int64), np.zeros(len(cells.rows), dtype=np.int64)
    held: list[list[int]] = []
    for k in range(cells.slices):
        room = 0
        for cell in (c for c in range(k, len(cells.rows), cells.slices) if cells.rows[c]):
            rows = int(cells.rows[cell])
            if rows > size:
                parts[cell] = -(-rows // size)
                first[cell] = len(held)
                held += [[cell] for _ in range(parts[cell])]
                room = 0
                continue
            if rows > room:
                held.append([])
                room = size
            first[cell], parts[cell] = len(held) - 1, 1
            held[-1].append(cell)
            room -= rows
    return Blocks(first, parts, [np.array(c) for c in held])


QUERY = ["h1", "h2", "embedding", "wants", "in_batch", "at", "article_id", "story_id"]
_QUERY_SCHEMA = "h1 long, h2 long, embedding array<float>, wants int, in_batch int, at long, article_id long, story_id long"


def _with_blocks(queries: DataFrame, cells: Cells, blocks: Blocks, threshold: float) -> DataFrame:
    """A row per query and block that it has to meet; bit k of ``met`` tells whether it meets the block's cell k."""

    def reach(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            met = cells.reached(_unit(frame["embedding"]), frame["in_batch"].to_numpy(), frame["at"].to_numpy(), threshold)
            own: list[list[int]] = [[] for _ in range(len(frame))]
            bits: list[list[bytes]] = [[] for _ in range(len(frame))]
            for block, members in enumerate(blocks.cells):
                mine = met[:, members]
                packed = np.packbits(mine, axis=1)
                for row in np.flatnonzero(mine.any(axis=1)):
                    own[row].append(block)
                    bits[row].append(packed[row].tobytes())
            yield frame.assign(block=own, met=bits)[[bool(x) for x in own]]

    reached = queries.select(*QUERY).mapInPandas(reach, f"{_QUERY_SCHEMA}, block array<int>, met array<binary>")
    return reached.select(*QUERY, F.inline(F.arrays_zip("block", "met")))


def deal(queries: DataFrame, candidates: DataFrame, cells: Cells, blocks: Blocks, q_parts: int, threshold: float) -> DataFrame:
    """Rows by ``pair`` of a block and a part of its queries: its candidates (kind 0) and the queries that meet it."""
    spark = candidates.sparkSession
    places = spark.createDataFrame(
        [(c, int(blocks.first[c]), int(blocks.parts[c])) for c in np.flatnonzero(blocks.parts).tolist()], "cell int, first int, parts int"
    )
    own = (F.col("first") + F.pmod("h1", F.col("parts"))).cast("int")
    c_rows = candidates.join(F.broadcast(places), "cell").select(
        F.explode(F.sequence(own * q_parts, own * q_parts + q_parts - 1)).alias("pair"), F.lit(0).alias("kind"), "cell",
        F.lit(None).cast("binary").alias("met"), *QUERY,
    )
    q_rows = _with_blocks(queries, cells, blocks, threshold).select(
        (F.col("block") * q_parts + F.pmod("h2", F.lit(q_parts))).cast("int").alias("pair"), F.lit(1).alias("kind"), F.lit(-1).alias("cell"), "met", *QUERY
    )
    return c_rows.unionByName(q_rows)


BEST_SCHEMA = (
    "h1 long, h2 long, kind int, sim double, in_batch int, at long, article_id long, story_id long"
)


class _Rows:
    """Rows of record batches as arrays: vectors as given, their lengths, their place."""

    def __init__(self, batches: list[pa.RecordBatch]):
        lists = [b.column("embedding") for b in batches]
        grids = [x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for x in lists]
        self.raw = grids[0] if len(grids) == 1 else np.concatenate(grids)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw, dtype=np.float64))
        for name in ("h1", "h2", "cell", "in_batch", "at", "article_id", "story_id", "wants"):
            setattr(self, name, np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches]))

    def unit(self, rows) -> np.ndarray:
        return self.raw[rows].astype(np.float64) / self.length[rows, None]

    def single(self, rows) -> np.ndarray:
        return self.raw[rows] / self.length[rows, None].astype(np.float32)


def _axes(single: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those along which the vectors lie most first; any would do, these tell most early."""
    some = np.nan_to_num(single.astype(np.float64))
    return np.linalg.eigh(some.T @ some)[1][:, ::-1].astype(np.float32)


def _outline(single: np.ndarray, axes: np.ndarray, k: int) -> np.ndarray:
    """The vectors along the first ``k`` axes, and the length of the rest (rounded up) as one component more.

    The product of two outlines is never less than that of the vectors, by the Cauchy-Schwarz inequality for the rests.
    """
    out = np.empty((len(single), k + 1), dtype=np.float32)
    out[:, :k] = single @ axes[:, :k]
    out[:, k] = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", out[:, :k], out[:, :k]), 0) + np.float32(ROUNDING))
    return out


class _Block:
    """Candidates of a block in tiles; ``rank`` is the place in the order of the whole block.

    Tiles are parts of a cell: of ``RUN_ROWS`` that follow each other in the order, those that the axes describe alike.
    A cell's last tile is filled up with empty rows, which come after everything.
    """

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = self.rows = _Rows(batches)
        batches.clear()
        n, dim = rows.raw.shape
        self.order = np.lexsort((rows.article_id, rows.at, rows.in_batch))
        rank = np.empty(n, dtype=np.int64)
        rank[self.order] = np.arange(n)
        self.existing = int((rows.in_batch == 0).sum())
        self.steps = [k for k in AXES if 2 * k < dim]
        chunks = [slice(k, k + CHUNK) for k in range(0, n, CHUNK)]
        self.axes = _axes(rows.single(slice(None, None, -(-n // AXIS_ROWS)))) if self.steps else None
        outlines = [np.concatenate([_outline(rows.single(c), self.axes, k) for c in chunks]) for k in self.steps]
        rest = outlines[-1][:, -1] if self.steps else rank
        by_cell = np.lexsort((rank, rows.cell))
        held, starts, sizes = np.unique(rows.cell[by_cell], return_index=True, return_counts=True)
        run = (np.arange(n) - np.repeat(starts, sizes)) // RUN_ROWS
        by_cell = by_cell[np.lexsort((rest[by_cell], run, rows.cell[by_cell]))]
        tiles = -(-sizes // TILE_ROWS)
        first = np.cumsum(tiles) - tiles
        self.ranges = {int(c): (int(f), int(f + t)) for c, f, t in zip(held, first, tiles)}
        place = np.repeat(first * TILE_ROWS, sizes) + np.arange(n) - np.repeat(starts, sizes)
        size = int(tiles.sum()) * TILE_ROWS
        self.at = np.zeros(size, dtype=np.int64)  # row by place in the tiles
        self.at[place] = by_cell
        self.rank = np.full(size, n, dtype=np.int32)
        self.rank[place] = rank[by_cell]
        self.single = np.zeros((size, dim), dtype=np.float32)
        for c in chunks:
            self.single[place[c]] = rows.single(by_cell[c])
        self.outlines = []
        while outlines:
            self.outlines.insert(0, np.zeros((size, outlines[-1].shape[1]), dtype=np.float32))
            self.outlines[0][place] = outlines.pop()[by_cell]
        by_tile = self.rank.reshape(-1, TILE_ROWS)
        self.earliest, self.latest = by_tile.min(axis=1), by_tile.max(axis=1)

    def before(self, queries: _Rows) -> np.ndarray:
        """How many candidates come before each query's own first one."""
        n, rows = len(self.order), self.rows
        both = lambda name: np.concatenate([getattr(rows, name)[self.order], getattr(queries, name)])
        is_query = np.arange(n + len(queries.at)) >= n
        sorted_ = np.lexsort((~is_query, both("article_id"), both("at"), both("in_batch")))
        passed = np.cumsum(~is_query[sorted_])
        found = np.empty(len(queries.at), dtype=np.int64)
        asked = is_query[sorted_]
        found[sorted_[asked] - n] = passed[asked]
        return found


class _Best:
    """Best partner so far of each query for one question: similarity, rank, row among the block's candidates."""

    def __init__(self, block: _Block, queries: _Rows, limit: np.ndarray, threshold: float):
        self.block, self.queries, self.limit, self.threshold = block, queries, limit.astype(np.int32), threshold
        self.single = queries.single(slice(None))
        self.outlines = [_outline(self.single, block.axes, k) for k in block.steps]
        self.sim = np.full(len(limit), -2.0)
        self.rank = np.zeros(len(limit), dtype=np.int64)
        self.row = np.zeros(len(limit), dtype=np.int64)

    def least(self, asked) -> np.ndarray:
        """What a product in single precision, or a bound, must come to for the rows ``asked``."""
        return (np.maximum(self.sim[asked], self.threshold) - SLOP).astype(np.float32)

    def search(self, met: np.ndarray, members: list[int]) -> None:
        """Every tile of the cells met that holds an early enough candidate and whose bound reaches the best so far."""
        block = self.block
        bounds = np.full((len(block.earliest), len(self.limit)), -np.inf, dtype=np.float32)  # of a tile's products
        by_limit = np.argsort(self.limit, kind="stable")
        for k, cell in enumerate(members):
            low, high = block.ranges.get(cell, (0, 0))
            asked = by_limit[met[by_limit, k]]
            for part in range(0, len(asked), QUERY_SLICE):
                some = asked[part : part + QUERY_SLICE]
                # Runs lie in the order, so that the tiles before these queries come first.
                early = np.flatnonzero(block.earliest[low:high] < self.limit[some[-1]])
                last = low + int(early[-1]) + 1 if len(early) else low
                for start in range(low, last, CANDIDATE_TILES):
                    end = min(last, start + CANDIDATE_TILES)
                    if block.steps:
                        products = self.outlines[0][some] @ block.outlines[0][start * TILE_ROWS : end * TILE_ROWS].T
                        bounds[start:end, some] = products.reshape(len(some), -1, TILE_ROWS).max(axis=2).T
                    else:
                        bounds[start:end, some] = np.inf
        bounds[self.limit[None, :] <= block.earliest[:, None]] = -np.inf
        for tile in range(len(bounds)):
            some = np.flatnonzero(bounds[tile] >= self.least(slice(None)))
            place = slice(tile * TILE_ROWS, (tile + 1) * TILE_ROWS)
            for mine, theirs in zip(self.outlines[1:], block.outlines[1:]):
                if len(some):
                    some = some[(mine[some] @ theirs[place].T).max(axis=1) >= self.least(some)]
            if len(some):
                self.compare(some, tile)

    def compare(self, asked: np.ndarray, tile: int) -> None:
        """The rows ``asked`` with the candidates of a tile."""
        block, queries = self.block, self.queries
        place = slice(tile * TILE_ROWS, (tile + 1) * TILE_ROWS)
        sims, at, ranks = self.single[asked] @ block.single[place].T, block.at[place], block.rank[place]
        limit = self.limit[asked]
        if limit.min() <= block.latest[tile]:
            sims = np.where(ranks < limit[:, None], sims, np.float32(-2))
        top = sims.max(axis=1)
        hot = np.flatnonzero(top >= self.least(asked))
        if not len(hot):
            return
        lowest = np.maximum(top[hot] - np.float32(SLOP), self.least(asked[hot]))
        q, c = np.nonzero(sims[hot] >= lowest[:, None])
        if len(q) > max(EXACT_PAIRS, len(hot) * sims.shape[1] // 16):  # many nearly equal ones
            early = np.argsort(ranks, kind="stable")
            grid = np.round(queries.unit(asked[hot]) @ block.rows.unit(at[early]).T, DIGITS)
            grid[ranks[early] >= limit[hot, None]] = -2.0
            best = grid.argmax(axis=1)  # the first maximum: the lowest order
            q, c, exact = np.arange(len(hot)), early[best], grid[np.arange(len(hot)), best]
        else:
            exact = np.empty(len(q))
            for k in range(0, len(q), EXACT_PAIRS):
                part = slice(k, k + EXACT_PAIRS)
                exact[part] = np.einsum("ij,ij->i", queries.unit(asked[hot[q[part]]]), block.rows.unit(at[c[part]]))
            exact = np.round(exact, DIGITS)
            order = np.lexsort((ranks[c], -exact, q))
            lead = order[np.concatenate(([True], q[order][1:] != q[order][:-1]))]
            q, c, exact = q[lead], c[lead], exact[lead]
        mine = asked[hot[q]]
        better = (exact >= self.threshold) & ((exact > self.sim[mine]) | ((exact == self.sim[mine]) & (ranks[c] < self.rank[mine])))
        mine, c = mine[better], c[better]
        self.sim[mine], self.rank[mine], self.row[mine] = exact[better], ranks[c], at[c]


def _block_best(blocks: Blocks, q_parts: int, threshold: float):
    def answers(block: _Block, pair: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        members = blocks.cells[pair // q_parts]
        queries = _Rows([batch])
        met = np.frombuffer(b"".join(batch.column("met").to_pylist()), np.uint8).reshape(len(queries.at), -1)
        met = np.unpackbits(met, axis=1, count=len(members)).astype(bool)
        # A query without a candidate of its own has nothing before it and asks for clustered ones alone.
        limits = {EARLIER: block.before(queries), EXISTING: np.full(len(queries.at), block.existing)}
        for kind, limit in limits.items():
            limit = np.where(queries.wants & (1 << kind), limit, 0)
            if not limit.any():
                continue
            one = _Best(block, queries, limit, threshold)
            one.search(met, members.tolist())
            some = np.flatnonzero(one.sim >= threshold)
            row = one.row[some]
            columns = [queries.h1[some], queries.h2[some], np.full(len(some), kind, np.int32), one.sim[some]]
            columns += [getattr(block.rows, c)[row] for c in ("in_batch", "at", "article_id", "story_id")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in BEST_SCHEMA.split(", ")])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best earlier and best already-clustered candidate of each query; rows come by pair, candidates first."""
        held: list[pa.RecordBatch] = []
        held_pair, block = -1, None
        for batch in batches:
            pair, kind = batch.column("pair").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((pair[1:] != pair[:-1]) | (kind[1:] != kind[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pair)]):
                if low == high:
                    continue
                rows, own = batch.slice(low, high - low), int(pair[low])
                if own != held_pair:
                    held, held_pair, block = [], own, None
                if kind[low] == 0:
                    held.append(rows)
                elif held or block is not None:
                    if block is None:
                        block, held = _Block(held), []
                    yield from answers(block, own, rows)

    return best


def _group_parents(groups: DataFrame, threshold: float, block_rows: int, cell_rows: int) -> DataFrame:
    """Per asking group: best earlier partner and best already-clustered partner, at or above the threshold."""
    asking = groups.where("asks")
    plan = plan_cells(groups, threshold, cell_rows)
    if plan is None:
        nothing = F.lit(None).cast(f"struct<sim:double,place:{ORDER_TYPE}>")
        return asking.select(*GROUP, "first", nothing.alias("earlier"), nothing.alias("existing"))
    candidates, cells = plan
    blocks = plan_blocks(cells, block_rows)
    n_blocks = len(blocks.cells)
    q_parts = max(1, min(-(-TASKS // n_blocks), asking.count() // QUERY_ROWS))
    rows = deal(_flat(asking), candidates, cells, blocks, q_parts, threshold)
    dealt = rows.repartitionById(n_blocks * q_parts, "pair").sortWithinPartitions("pair", "kind")
    best = dealt.mapInArrow(_block_best(blocks, q_parts, threshold), BEST_SCHEMA)
    # Highest similarity, then lowest order: the order enters negated.
    ranked = F.struct("sim", (-F.col("in_batch")).alias("b"), (-F.col("at")).alias("t"), (-F.col("article_id")).alias("i"), "story_id")
    tops = best.groupBy(*GROUP).agg(
        F.max(F.when(F.col("kind") == EARLIER, ranked)).alias("e"), F.max(F.when(F.col("kind") == EXISTING, ranked)).alias("x")
    )

    def plain(name: str) -> Column:
        c = F.col(name)
        story = F.when(c["b"] == 0, c["story_id"])
        place = F.struct((-c["b"]).alias("in_batch"), (-c["t"]).alias("at"), (-c["i"]).alias("article_id"), story.alias("story_id"))
        return F.when(c.isNotNull(), F.struct(c["sim"].alias("sim"), place.alias("place")))

    return asking.select(*GROUP, "first").join(
        tops.select(*GROUP, plain("e").alias("earlier"), plain("x").alias("existing")), GROUP, "left"
    )


def _parents(articles: DataFrame, as_of: Column, lookback_days: int, threshold: float, block_rows: int, cell_rows: int):
    members = _members(articles, as_of, lookback_days)
    with passing_tables(articles.sparkSession) as keep:
        groups = stash(_groups(members), "vector-groups")
        parents = keep(_group_parents(groups, threshold, block_rows, cell_rows), "vector-parents")
    batch = members.where("place.in_batch = 1").select("article_id", *GROUP, "is_candidate")
    return batch, parents


def _partner_columns() -> tuple[Column, Column]:
    """(similarity, place) of a batch article's parent from its group's columns."""
    first, earlier, existing = F.col("first"), F.col("earlier"), F.col("existing")
    is_first = F.col("article_id") == first["article_id"]
    own = F.struct(F.lit(1.0).alias("sim"), first.alias("place"))
    later = F.when(earlier["sim"] >= 1.0, earlier).otherwise(own)
    pick = (
        F.when(~F.col("is_candidate"), existing)
        .when(is_first, earlier)
        .when(first.isNotNull(), later)
    )
    return pick["sim"], pick["place"]


def nearest_predecessor(
    articles: DataFrame, as_of: Column, lookback_days: int = C.LOOKBACK_DAYS, threshold: float = C.SIMILARITY_THRESHOLD,
    block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(article_id, parent_id, similarity) of each batch article; nulls when nothing reaches the threshold.

    ``articles`` has (article_id, published_at, embedding, story_id); a null
    story_id marks the batch.
    """
    batch, parents = _parents(articles, as_of, lookback_days, threshold, block_rows, cell_rows)
    sim, place = _partner_columns()
    return batch.join(parents, GROUP, "left").select(
        "article_id", place["article_id"].alias("parent_id"), sim.alias("similarity")
    )


def _resolve_roots(nodes: DataFrame) -> DataFrame:
    """Pointer jumping: (node, story_id, is_new) from (node, ptr, story_id, is_new); ptr null when settled.

    Settled rows leave the loop, so each round reads and writes the open ones alone, beside the settled rows they
    look up.  The number of rounds is the logarithm of the longest chain.
    """
    nodes = cut_lineage(nodes)
    settled, open_rows = [nodes.where("ptr is null")], nodes.where("ptr is not null")
    while not open_rows.isEmpty():
        targets = [part.select(F.col("node").alias("ptr"), F.lit(None).cast("long").alias("next"), F.col("story_id").alias("s"), F.col("is_new").alias("n")) for part in settled]
        targets.append(open_rows.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("story_id").alias("s"), F.col("is_new").alias("n")))
        looked_up = reduce(DataFrame.unionByName, targets)
        jumped = cut_lineage(open_rows.join(looked_up, "ptr", "left").select(
            "node", F.col("next").alias("ptr"), F.col("s").alias("story_id"), F.col("n").alias("is_new")
        ))
        settled.append(jumped.where("ptr is null"))
        open_rows = jumped.where("ptr is not null")
    return reduce(DataFrame.unionByName, settled).select("node", "story_id", "is_new")


def assign_stories(
    articles: DataFrame, as_of: Column, lookback_days: int = C.LOOKBACK_DAYS, threshold: float = C.SIMILARITY_THRESHOLD,
    block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Story of every batch article: (article_id, story_id, is_new_story, parent_id, similarity).

    A new story takes the id of its first article and is marked ``is_new_story``.
    """
    batch, parents = _parents(articles, as_of, lookback_days, threshold, block_rows, cell_rows)
    earlier = F.col("earlier.place")
    nothing = F.lit(None).cast("long")
    # One node per distinct vector whose earliest candidate is of the batch.
    start = parents.where("first.in_batch = 1").select(
        F.col("first.article_id").alias("node"),
        F.when(earlier["in_batch"] == 1, earlier["article_id"]).alias("ptr"),
        F.when(earlier.isNull(), F.col("first.article_id")).when(earlier["in_batch"] == 0, earlier["story_id"]).otherwise(nothing).alias("story_id"),
        F.when(earlier.isNull(), True).when(earlier["in_batch"] == 0, False).alias("is_new"),
    )
    roots = _resolve_roots(start)
    # The story of a group's candidates, resolved once per distinct vector.
    resolved = parents.withColumn("node", F.when(F.col("first.in_batch") == 1, F.col("first.article_id"))).join(
        roots.withColumnRenamed("story_id", "root_story"), "node", "left"
    ).select(*GROUP, "first", "earlier", "existing", "root_story", "is_new")
    sim, place = _partner_columns()
    rows = batch.join(resolved, GROUP, "left").withColumn("sim", sim).withColumn("place", place)
    alone = F.col("place").isNull()
    joins_existing = F.col("place.in_batch") == 0
    return rows.select(
        "article_id",
        F.when(alone, F.col("article_id")).when(joins_existing, F.col("place.story_id")).otherwise(F.col("root_story")).alias("story_id"),
        F.when(alone, True).when(joins_existing, False).otherwise(F.col("is_new")).alias("is_new_story"),
        F.col("place.article_id").alias("parent_id"),
        F.col("sim").alias("similarity"),
    )


def story_rollup(clustered: DataFrame) -> DataFrame:
    """Count, span and title of each story; the first member by (published_at, article_id) names it."""
    lead = F.min(F.struct("published_at", "article_id", F.substring("headline", 1, C.STORY_TITLE_CHARS).alias("title")))
    return (
        clustered.where("story_id is not null")
        .groupBy("story_id")
        .agg(F.count(F.lit(1)).alias("article_count"), F.max("published_at").alias("last_seen_at"), lead.alias("lead"))
        .select("story_id", "article_count", F.col("lead.published_at").alias("first_seen_at"), "last_seen_at", F.col("lead.title").alias("title"))
    )
