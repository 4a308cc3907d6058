"""Corpus pipeline: documents to packed sequences, in five stages.

Each stage reads what the one before has written as Parquet, works on all of it, and applies its decisions.  All but
the last return the columns of ``documents``.  No stage drops a document for its null columns; an empty table gives
no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.llm import exact_dedup, jaccard_join, packing, quality_model, substring_dedup
from pressgrid.llm.queries import vocabulary
from pressgrid.llm.store import documents_of, labels_of, stash
from pressgrid.session import prepare


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is fitted on labelled rows of ``docs``."""
    prepare(spark)
    return quality_model.good_documents(docs, quality_model.train(docs, labels_of(spark, sf_dir)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shared 5-word shingles."""
    prepare(spark)
    return jaccard_join.one_of_each(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; ``n_chars`` follows the text."""
    prepare(spark)
    cut = substring_dedup.substring_dedup(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, laid into sequences of 1024."""
    prepare(spark)
    return packing.pack_documents(docs, vocabulary(spark))


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("packing", pack),
]

# Classifier and tokenizer can't be written in SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
