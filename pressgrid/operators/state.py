"""Article state machine: applying stage outcomes as new versions of the rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from pressgrid import constants as C


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())]), key)


def is_rate_limit(name: Column, code: Column, status: Column) -> Column:
    """A 429 in any of its shapes: error class name, numeric code, or status text."""
    by_name = F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit("ratelimit"))
    by_code = F.coalesce(code == 429, F.lit(False))
    by_status = F.coalesce(F.upper(status) == "RESOURCE_EXHAUSTED", F.lit(False))
    return by_name | by_code | by_status


def _advance(articles: DataFrame, outcomes: DataFrame, as_of: Column, held: Column, error_chars: int) -> DataFrame:
    attempts = F.coalesce("attempt_count", F.lit(0).cast("long")) + 1
    touched = F.col("ok").isNotNull()
    success = F.coalesce("ok", F.lit(False))
    held = touched & ~success & held
    failure = touched & ~success & ~held
    dead = failure & (attempts >= C.MAX_ATTEMPTS)
    state = F.col("processing_state")
    return articles.join(outcomes, "article_id", "left").select(
        *[c for c in articles.columns if c not in ("processing_state", "state_updated_at", "state_error", "attempt_count")],
        F.when(success, F.coalesce(_lookup(C.NEXT_STATE, state), state))
        .when(dead, F.coalesce(_lookup(C.FAILED_STATE, state), F.lit("failed_analyze")))
        .otherwise(state).alias("processing_state"),
        F.when(touched, as_of).otherwise(F.col("state_updated_at")).alias("state_updated_at"),
        F.when(success, F.lit(None).cast("string"))
        .when(touched, F.substring("error", 1, error_chars))
        .otherwise(F.col("state_error")).alias("state_error"),
        F.when(success, F.lit(0).cast("long")).when(failure, attempts).otherwise(F.col("attempt_count")).alias("attempt_count"),
    )


def apply_outcomes(articles: DataFrame, outcomes: DataFrame, as_of: Column, error_chars: int = C.ERROR_CHARS) -> DataFrame:
    """Success: next state, counter 0, no error.  Failure: counter + 1; the third one is final.

    The first ``error_chars`` characters of an error are stored.
    """
    return _advance(articles, outcomes.select("article_id", "ok", "error"), as_of, F.lit(False), error_chars)


def apply_llm_outcomes(articles: DataFrame, outcomes: DataFrame, as_of: Column, error_chars: int = C.ERROR_CHARS) -> DataFrame:
    """As ``apply_outcomes``, but a rate limit only records the error; state and counter stay."""
    held = is_rate_limit(F.col("error_name"), F.col("error_code"), F.col("error_status"))
    return _advance(articles, outcomes.select("article_id", "ok", "error", "error_name", "error_code", "error_status"), as_of, held, error_chars)


def advance_compared(articles: DataFrame, compared: DataFrame, as_of: Column) -> DataFrame:
    """Analysed articles of compared stories become complete; the rest is untouched."""
    flags = compared.select("story_id").distinct().withColumn("was_compared", F.lit(True))
    moves = F.coalesce("was_compared", F.lit(False)) & (F.col("processing_state") == "analyzed")
    return articles.join(flags, ["story_id"], "left").select(
        *[c for c in articles.columns if c not in ("processing_state", "state_updated_at", "state_error")],
        F.when(moves, F.lit("complete")).otherwise(F.col("processing_state")).alias("processing_state"),
        F.when(moves, as_of).otherwise(F.col("state_updated_at")).alias("state_updated_at"),
        F.when(~moves, F.col("state_error")).alias("state_error"),
    )


def _next_run(runs: DataFrame, started_at: Column, triggered_by: str) -> DataFrame:
    """run_id after the last one of ``runs``, start and trigger; always one row."""
    if triggered_by not in C.RUN_TRIGGERS:
        raise ValueError(f"triggered_by is one of {C.RUN_TRIGGERS}")
    return runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).cast("long").alias("run_id")).select(
        "run_id", started_at.alias("started_at"), F.lit(triggered_by).alias("triggered_by")
    )


def open_run(runs: DataFrame, started_at: Column, triggered_by: str = "cron") -> DataFrame:
    """The ledger's row of a run that begins: running, all counts 0, no end."""
    zero = F.lit(0).cast("long")
    return _next_run(runs, started_at, triggered_by).select(
        "*", F.lit(None).cast("timestamp").alias("completed_at"),
        *(zero.alias(c) for c in ("articles_discovered", "articles_inserted", "articles_failed", "llm_calls")),
        F.lit("running").alias("status"), F.lit(None).cast("string").alias("error"),
    )


def run_ledger_row(
    articles: DataFrame, outcomes: DataFrame, runs: DataFrame, offered: DataFrame, started_at: Column, as_of: Column,
    triggered_by: str = "cron", error: str | None = None, error_chars: int = C.ERROR_CHARS,
) -> DataFrame:
    """One row for a finished run: number, span, trigger, URLs, stage successes, failures, model calls, status, error.

    ``offered`` has a row per URL the run found, with ``inserted`` true for those that were new.  No outcome at all means
    skipped, no success at all failed; a run that ended by an ``error`` is failed whatever it did before.
    """
    staged = articles.select("article_id", "processing_state", "attempt_count").join(outcomes, "article_id")
    ok = F.col("ok")
    stage = F.col("processing_state")
    failure = ~ok & (F.coalesce("attempt_count", F.lit(0)) + 1 >= C.MAX_ATTEMPTS)
    counts = staged.agg(
        F.count(F.lit(1)).alias("touched"),
        F.count_if(ok & (stage == "discovered")).alias("articles_extracted"),
        F.count_if(ok & (stage == "extracted")).alias("articles_embedded"),
        F.count_if(ok & (stage == "embedded")).alias("articles_clustered"),
        F.count_if(ok & (stage == "clustered")).alias("articles_enriched"),
        F.count_if(failure).alias("articles_failed"),
        F.count_if(stage == "clustered").alias("llm_calls"),
        F.count_if(ok).alias("succeeded"),
    )
    found = offered.agg(F.count(F.lit(1)).alias("articles_discovered"), F.count_if("inserted").alias("articles_inserted"))
    opened = _next_run(runs, started_at, triggered_by)
    failed = F.lit(error).cast("string")
    status = F.when(failed.isNotNull(), "failed").when(F.col("touched") == 0, "skipped").when(F.col("succeeded") == 0, "failed").otherwise("success")
    return counts.select(
        *(opened.select(c).scalar().alias(c) for c in opened.columns),
        as_of.alias("completed_at"),
        *(found.select(c).scalar().alias(c) for c in found.columns),
        "articles_extracted", "articles_embedded", "articles_clustered", "articles_enriched",
        "articles_failed", "llm_calls", status.alias("status"), F.substring(failed, 1, error_chars).alias("error"),
    )
