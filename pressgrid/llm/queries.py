"""Registered queries of this subpackage: thin applications of its operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressgrid.llm import (
    bpe, chat_format, exact_dedup, importance, jaccard_join, learning, line_dedup, packing, quality_model, quality_rules,
    sanitising, substring_dedup, toxicity, whitening,
)
from pressgrid.llm.store import documents_of, labels_of
from pressgrid.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(spark: SparkSession) -> str:
    """Path of the installed public vocabulary; the session can name another."""
    return spark.conf.get("pressgrid.vocabulary", None) or public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = documents_of(spark, sf_dir)
    scored = toxicity.toxicity(documents, toxicity.train(documents, labels_of(spark, sf_dir)))
    return scored.withColumn("held_out", learning.held_out(F.col("doc_id"), *toxicity.HOLD))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents_of(spark, sf_dir), vocabulary(spark))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents_of(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents_of(spark, sf_dir))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return chat_format.format_chats(conversations)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(documents_of(spark, sf_dir).select("doc_id", "text"), max_bits=None, exact_words=1)
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(documents_of(spark, sf_dir).select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), exact_dedup.SPACES, " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents_of(spark, sf_dir), vocabulary(spark))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents_of(spark, sf_dir))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = documents_of(spark, sf_dir)
    scored = quality_model.quality(documents, quality_model.train(documents, labels_of(spark, sf_dir)))
    return scored.withColumn("held_out", learning.held_out(F.col("doc_id"), *quality_model.HOLD))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    return whitening.whitened_embeddings(embeddings).withColumn("deviation", F.col("deviation").cast("long"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return importance.importance_draw(documents_of(spark, sf_dir), benchmark)


def op13_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitising.sanitise(documents_of(spark, sf_dir))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in sanitising.KINDS]
    return found.select("doc_id", *counts, F.sha2(sanitising.digest("base"), 256).alias("base_sha256"), sanitising.digest("spans").alias("spans"))


def all_queries() -> dict[str, Query]:
    return {name: value for name, value in globals().items() if name.startswith("op") and callable(value)}
