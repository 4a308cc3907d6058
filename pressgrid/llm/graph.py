"""Connected components of an edge table by repeated contraction; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressgrid.llm.store import passing_tables, stash


def _edges(pairs: DataFrame) -> DataFrame:
    """(high, low) of each link between different nodes, once."""
    return pairs.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high <> low").distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root): follow parents to the top; each round doubles the steps."""
    done = None
    open_ = stash(parents.select("node", F.col("parent").alias("root")), "parents")
    while True:
        up = open_.select(F.col("node").alias("root"), F.col("root").alias("above"))
        stepped = stash(open_.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNull().alias("top")), "roots")
        settled = stepped.where("top").select("node", "root")
        done = settled if done is None else done.unionByName(settled)
        rest = stepped.where("not top").select("node", "root")
        if rest.isEmpty():
            return done
        # Settled nodes stay in reach as parents; their own rows no longer move.
        open_ = stash(rest, "parents")
        known = done.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = open_.join(known, "root", "left")
        done = done.unionByName(jumped.where("above is not null").select("node", F.col("above").alias("root")))
        open_ = stash(jumped.where("above is null").select("node", "root"), "parents")
        if open_.isEmpty():
            return done


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); ``root`` is the smallest node of the component.

    A round hangs every node below its smallest neighbour and contracts the trees, so at most half the nodes stay.  Hot
    nodes cost a partial minimum before the shuffle; nothing of the graph reaches the driver.
    """
    with passing_tables(pairs.sparkSession) as keep:
        return keep(_contracted(pairs), "components")


def _contracted(pairs: DataFrame) -> DataFrame:
    edges = stash(_edges(pairs), "edges")
    assigned = None
    while True:
        parents = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent"))
        lows = edges.select(F.col("low").alias("node")).distinct()
        tops = lows.join(parents.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
        roots = stash(_roots(parents).unionByName(tops), "contracted")
        if assigned is None:
            assigned = roots
        else:
            moved = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
            assigned = stash(assigned.join(moved, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "assigned")
        high = roots.select(F.col("node").alias("high"), F.col("root").alias("b"))
        low = roots.select(F.col("node").alias("low"), F.col("root").alias("a"))
        edges = stash(_edges(edges.join(high, "high").join(low, "low").select("a", "b")), "edges")
        if edges.isEmpty():
            return assigned
