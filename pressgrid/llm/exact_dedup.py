"""Exact de-duplication of a batch against an immutable snapshot.

Texts are equal when identical after each run of 0x20, 0x09-0x0D became one blank.  A snapshot keeps one row per
distinct digest, dealt to buckets by digest, and a static binary-fuse filter per bucket.  A batch is first grouped by
digest alone, so copies inside it meet before anything else; its distinct digests then pass the filters, those that
pass join the snapshot's exact buckets, and the bytes of the two representatives are compared.

Of a group the row with the smallest doc_id stays; null doc_ids come last, and of rows with the same doc_id one stays.
Null text is empty text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pressgrid.llm import fuse
from pressgrid.llm.store import join_grouped, stash

SPACES = r"[\x20\x09-\x0D]+"
BUCKET_KEYS = 100_000
KEY = ["sha", "n_bytes"]


class Snapshot(NamedTuple):
    """Immutable index: ``groups`` (sha, n_bytes, keep, size), one ``filters`` row per bucket."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(documents: DataFrame, *more: Column) -> DataFrame:
    """doc_id, row_no, sha (binary), n_bytes, and ``more``: one row per document."""
    text = documents.select("doc_id", normalised(F.col("text")).alias("normal"), *more)
    rest = [c for c in text.columns if c not in ("doc_id", "normal")]
    return text.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_no"),
        F.unhex(F.sha2("normal", 256)).alias("sha"),
        F.octet_length("normal").cast("long").alias("n_bytes"),
        *rest,
    )


def grouped(rows: DataFrame) -> DataFrame:
    """sha, n_bytes, keep (order key, doc_id and row_no of the row that stays), size."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")
    return rows.groupBy(*KEY).agg(F.min(rank).alias("keep"), F.count(F.lit(1)).alias("size"))


def _keys(sha: pd.Series) -> np.ndarray:
    """64-bit keys from the digests' second eight bytes."""
    return np.frombuffer(b"".join(bytes(x)[8:16] for x in sha), dtype=">u8").astype(np.uint64)


def _bucket(buckets: int) -> Column:
    """Bucket by the digests' first bytes: distinct digests spread evenly, however many copies they have."""
    return F.pmod(F.conv(F.hex(F.substring("sha", 1, 6)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def build_snapshot(rows: DataFrame) -> Snapshot:
    """Index rows with digests; both tables are written once and never change."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        made = fuse.build(_keys(frame["sha"]))
        return pd.DataFrame(
            {"bucket": frame["bucket"].iloc[:1], "seed": made.seed, "segment": made.segment, "spans": made.spans, "slots": [made.table.tobytes()]}
        )

    groups = stash(grouped(rows), "snapshot-groups")
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))
    groups = groups.withColumn("bucket", _bucket(buckets))
    filters = (
        groups.select("bucket", "sha")
        .groupBy("bucket")
        .applyInPandas(build, "bucket int, seed long, segment long, spans long, slots binary")
    )
    return Snapshot(groups, stash(filters, "snapshot-filters"), buckets)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Rows of ``batch`` (one per digest) that pass the snapshot's filters; none of its members is lost."""

    def ask(_: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or filters.empty:
            return rows.iloc[:0]
        f = filters.iloc[0]
        made = fuse.Filter(int(f["seed"]), int(f["segment"]), int(f["spans"]), np.frombuffer(f["slots"], np.uint8))
        return rows[fuse.might_hold(made, _keys(rows["sha"]))]

    dealt = batch.select(*KEY, _bucket(snapshot.buckets).alias("bucket"))
    return (
        dealt.groupBy("bucket")
        .cogroup(snapshot.filters.groupBy("bucket"))
        .applyInPandas(ask, "sha binary, n_bytes long, bucket int")
        .select(*KEY)
    )


def _same_bytes(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys of the pairs (sha, n_bytes, old_id, new_id) whose two texts are equal byte by byte."""
    wanted = pairs.select(*KEY, F.explode(F.array("old_id", "new_id")).alias("wanted_id"))
    texts = documents.select("doc_id", normalised(F.col("text")).alias("normal"))
    # The list of representatives grows with the input, so it is merged with the texts at every size.
    found = texts.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("wanted_id"))).where(F.unhex(F.sha2("normal", 256)) == F.col("sha"))
    return found.groupBy(*KEY).agg((F.min("normal") == F.max("normal")).alias("same")).where("same").select(*KEY)


def exact_dedup(documents: DataFrame, incoming: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Rows where ``incoming`` holds are the new batch, all others the snapshot; by default the upper half of the doc_ids.
    """
    if incoming is None:
        low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
        incoming = F.col("doc_id") > ((low or 0) + (high or 0)) // 2
    rows = stash(digests(documents, F.coalesce(incoming, F.lit(False)).alias("is_new")), "digests")
    snapshot = build_snapshot(rows.where("not is_new"))
    fresh = stash(grouped(rows.where("is_new")), "batch-groups")
    passed = stash(screen(fresh, snapshot), "screened")
    old = snapshot.groups.select(*KEY, F.col("keep").alias("old_keep"), F.col("size").alias("old_size"))
    met = stash(passed.join(old, KEY).join(fresh, KEY), "met")
    same = _same_bytes(documents, met.select(*KEY, F.col("old_keep.doc_id").alias("old_id"), F.col("keep.doc_id").alias("new_id")))
    known = stash(met.join(same, KEY, "left_semi"), "known")

    # Groups of either side take the other's copies in; all else stays as it was grouped.
    joint = known.select(*KEY, F.least("keep", "old_keep").alias("keep"), (F.col("size") + F.col("old_size")).alias("size"))
    alone = lambda groups: groups.select(*KEY, "keep", "size").join(known.select(*KEY), KEY, "left_anti")
    both = lambda: (F.lit(True), F.lit(False))
    classes = stash(
        joint.withColumn("is_new", F.explode(F.array(*both())))
        .unionByName(alone(snapshot.groups).withColumn("is_new", F.lit(False)))
        .unionByName(alone(fresh).withColumn("is_new", F.lit(True))),
        "classes",
    )
    joined = join_grouped(rows, classes, [*KEY, "is_new"], "size", rows.count())
    return joined.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row_no") == F.col("keep.row_no")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def distinct_documents(documents: DataFrame) -> DataFrame:
    """The documents that stay, unchanged; of rows with the same doc_id and text one stays."""
    kept = exact_dedup(documents).where("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__sha"))
    sha = F.unhex(F.sha2(normalised(F.col("text")), 256))
    found = documents.withColumn("__own", sha).join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_semi")
    # Rows that share doc_id and text are rare; only they go through the second grouping.
    again = stash(digests(documents).groupBy("doc_id", "sha").count().where("count > 1").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")), "repeated")
    if again.isEmpty():
        return found.drop("__own")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha"))
    once = found.join(again, same, "left_semi").dropDuplicates(["doc_id", "__own"])
    return found.join(again, same, "left_anti").unionByName(once).drop("__own")
