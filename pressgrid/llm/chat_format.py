"""Chat formatting of logged conversations, each logged again after every turn.

A conversation that is the start of a longer one is a snapshot of it and is dropped; of equal conversations the one
with the smallest conv_id stays.  Starts are known by rolling hashes: the hash of the first k turns is a sum over turns
of a hash of (k, role, text), in two independent halves, so a running sum gives all starts of a conversation.  An
anti-join of whole conversations with the starts of others leaves the maximal ones, and only those are rendered.

Running values are taken inside chunks of turns and then over chunks, so a conversation that holds a large share of all
turns is spread over tasks.  A conversation is rendered in parts of ``PART_TURNS`` turns; most have one part.

Cases: turns are ordered by turn (nulls first), role and text; repeated rows count once; null roles and texts are values
of their own and are rendered empty; rows with a null conv_id are one conversation; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressgrid.llm.store import stash

CHUNK_TURNS = 256
PART_TURNS = 64
# The marks around a turn.
OPENING, BREAK, CLOSING = "<|im_start|>", "\n", "<|im_end|>\n"


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the right keys go."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"__{key}")
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"__{key}"))
    return left.join(renamed, on, how).drop(*(f"__{key}" for key in keys))


def _running(turns: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """Add running sums of ``steps`` in the order of turns, first inside chunks, then over chunks."""
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    exact = {name: step.cast("decimal(20,0)") for name, step in steps.items()}
    totals = turns.groupBy("conv_id", "chunk").agg(*(F.sum(step).alias(f"__{name}") for name, step in exact.items()))
    before = totals.select("conv_id", "chunk", *(F.coalesce(F.sum(f"__{n}").over(over), F.lit(0)).alias(f"__{n}") for n in steps))
    local = turns.select("*", *(F.sum(step).over(inside).alias(name) for name, step in exact.items()))
    joined = _same(local, before, ["conv_id", "chunk"])
    return joined.select(*turns.columns, *((F.col(n) + F.col(f"__{n}")).cast("decimal(38,0)").alias(n) for n in steps))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (from 1), role, text, one, two: each turn with the hash of the conversation up to it."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    rows = rows.withColumn("chunk", F.expr(f"floor(turn / {CHUNK_TURNS})"))
    placed = _running(rows, {"k": F.lit(1)}).withColumn("k", F.col("k").cast("long"))
    values = [F.col("k"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    hashed = _running(placed, {"one": F.xxhash64(*values), "two": F.xxhash64(F.lit("two"), *values)})
    return hashed.select("conv_id", "k", "role", "text", "one", "two")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that start no longer one, from numbered turns."""
    last = turns.groupBy("conv_id").agg(F.max(F.struct("k", "one", "two")).alias("last"))
    whole = last.select("conv_id", "last.*")
    # Copies meet before the join; the starts of a common first turn are one row.
    order = F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id")
    classes = whole.groupBy("k", "one", "two").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("copies"))
    starts = _same(turns.select("conv_id", "k", "one", "two"), whole.select("conv_id", F.col("k").alias("n")), ["conv_id"])
    starts = starts.where("k < n").select("k", "one", "two").distinct()
    return classes.join(starts, ["k", "one", "two"], "left_anti").select("keep.conv_id", F.col("k").alias("n_turns"), "copies")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, part (from 0), n_turns, copies, rendered: the maximal conversations in chat marks."""
    turns = stash(numbered_turns(conversations), "chat-turns")
    kept = _same(turns, maximal_conversations(turns), ["conv_id"])
    marked = F.concat(F.lit(OPENING), F.coalesce("role", F.lit("")), F.lit(BREAK), F.coalesce("text", F.lit("")), F.lit(CLOSING))
    parts = kept.groupBy("conv_id", F.expr(f"(k - 1) div {PART_TURNS}").alias("part"), "n_turns", "copies").agg(
        F.sort_array(F.collect_list(F.struct("k", marked.alias("said")))).alias("said")  # at most PART_TURNS
    )
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join(F.col("said.said"), "").alias("rendered"))
