"""Upserts as plans: what to insert, update or leave, and the merged table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pressgrid.functions import labels


def outlets_upsert_plan(specs: DataFrame, outlets: DataFrame) -> DataFrame:
    """Action per outlet spec: insert, update (drift or inactive) or unchanged.  Logos are never cleared."""
    known = outlets.select(
        "slug", "outlet_id", F.col("name").alias("old_name"), F.col("rss_url").alias("old_rss_url"),
        F.col("website").alias("old_website"), F.col("active").alias("old_active"), "logo_url",
    )
    same = (
        F.col("name").eqNullSafe(F.col("old_name")) & F.col("rss_url").eqNullSafe(F.col("old_rss_url"))
        & F.col("website").eqNullSafe(F.col("old_website")) & F.col("old_active")
    )
    action = F.when(F.col("outlet_id").isNull(), "insert").when(same, "unchanged").otherwise("update")
    return specs.join(known, "slug", "left").select(
        "slug", "outlet_id", "name", "rss_url", "website", "logo_url", F.lit(True).alias("active"), action.alias("action")
    )


def bias_ratings_upsert_plan(records: DataFrame, outlets: DataFrame, ratings: DataFrame) -> DataFrame:
    """Action per rating record; records without outlet or with an unknown label are skipped."""
    old = ratings.select(
        "outlet_id", "source", F.col("original_label").alias("old_label"), F.col("normalized_category").alias("old_category"),
        F.col("rating_url").alias("old_url"), F.col("rated_at").alias("old_rated_at"), F.lit(True).alias("known"),
    )
    category = labels.bias_category(F.col("source"), F.col("original_label"))
    same = (
        F.col("original_label").eqNullSafe(F.col("old_label")) & F.col("category").eqNullSafe(F.col("old_category"))
        & F.col("rating_url").eqNullSafe(F.col("old_url")) & F.col("rated_at").eqNullSafe(F.col("old_rated_at"))
    )
    action = (
        F.when(F.col("outlet_id").isNull(), "skipped_no_outlet")
        .when(F.col("category").isNull(), "skipped_unmappable")
        .when(F.col("known").isNull(), "inserted")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    return (
        records.withColumn("category", category)
        .join(outlets.select("slug", "outlet_id"), records["outlet_slug"] == outlets["slug"], "left")
        .join(old, ["outlet_id", "source"], "left")
        .select("outlet_slug", "outlet_id", "source", "original_label", "category", "rating_url", "rated_at", action.alias("action"))
    )


def action_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def latest_wins_upsert(current: DataFrame, incoming: DataFrame, pk: str, version: str) -> DataFrame:
    """Merged table with one row per key, the one of the highest version.

    Incoming rows win ties.  max_by combines before the shuffle, so a key with
    very many versions never reaches one task whole.
    """
    columns = current.columns
    both = current.withColumn("fresh", F.lit(0)).unionByName(incoming.select(*columns).withColumn("fresh", F.lit(1)))
    rest = [c for c in columns if c != pk]
    best = both.groupBy(pk).agg(F.max_by(F.struct(*rest), F.struct(version, "fresh")).alias("row"))
    return best.select(pk, "row.*").select(*columns)
