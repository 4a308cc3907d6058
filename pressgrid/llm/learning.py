"""Labelled samples and held-out rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Documents a classifier is fitted on at most, those with the smallest hash of their doc_id.
SAMPLE_ROWS = 12_000


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def held_out(doc_id: Column, of: int, at: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``at``; a null doc_id is not held out."""
    return F.coalesce(remainder(doc_id, of) == at, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, of: int, at: int, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents that are not held out.

    Null labels and doc_ids are left out; of several labels of a document the smallest counts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), of, at))
    chosen = (
        usable.groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)  # bounds what is broadcast
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
