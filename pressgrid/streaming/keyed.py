"""Processors that keep a little state per key between micro-batches.

State lives in the state store of the query's checkpoint: a batch reads and writes the keys it holds, whatever the
history.  Before the exchange each Arrow batch is cut to the rows of a key that can matter, and a processor reads its
rows in chunks, so a key with a third of all rows neither fills a task nor its memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pressgrid import constants as C

STAGES = list(C.NEXT_STATE)  # what an article passes, in order
#: Outcomes after which an article is settled whatever they are: two failures and a success for each stage.
SETTLING = len(STAGES) * C.MAX_ATTEMPTS


def earliest(key: str, order: list[str], keep: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The first ``keep`` rows of each key in every batch of rows."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(order, kind="stable").groupby(key, sort=False, dropna=False).head(keep)

    return cut


def _first_rows(rows: Iterator[pd.DataFrame], order: list[str], keep: int) -> pd.DataFrame:
    """The first ``keep`` rows over all chunks of a key."""
    first: pd.DataFrame | None = None
    for chunk in rows:
        both = chunk if first is None else pd.concat([first, chunk])
        first = both.sort_values(order, kind="stable").head(keep)
    return first


class FirstOfUrl(StatefulProcessor):
    """Passes on the first entry of each URL; the URL is forgotten once event time is ``days`` past that entry."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "known boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            return
        first = _first_rows(rows, ["arrival"], 1)
        self.seen.update((True,))
        self.handle.registerTimer(int(first["fetched_at"].iloc[0].timestamp() * 1000) + self.days * 86_400_000)
        yield first

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class StoryReadiness(StatefulProcessor):
    """Running count, outlets and newest analysis of a story; passes on a story a batch touches while it is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "articles long, outlets long, latest long, compared long")
        self.outlets = handle.getMapState("outlets", "outlet_id long", "known boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        articles, outlets, latest, compared = self.totals.get() if self.totals.exists() else (0, 0, -1, -1)
        for chunk in rows:
            articles += int(chunk["articles"].sum())
            latest, compared = max(latest, int(chunk["latest"].max())), max(compared, int(chunk["compared"].max()))
            for outlet in chunk["outlet_id"].unique():
                if not self.outlets.containsKey((int(outlet),)):
                    self.outlets.updateValue((int(outlet),), (True,))
                    outlets += 1
        self.totals.update((articles, outlets, latest, compared))
        enough = articles >= C.COMPARE_MIN_ARTICLES and outlets >= C.COMPARE_MIN_OUTLETS
        if enough and (compared < 0 or latest > compared):
            yield pd.DataFrame({"story_id": [key[0]], "n_articles": [articles], "n_outlets": [outlets], "latest": [latest]})

    def close(self) -> None:
        pass


def outlet_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per story and outlet in every batch of rows: articles, newest analysis and comparison (-1 if none)."""
    for frame in frames:
        yield frame.groupby(["story_id", "outlet_id"], as_index=False).agg(articles=("articles", "sum"), latest=("latest", "max"), compared=("compared", "max"))


def first_of_url(entries: DataFrame, known: DataFrame, days: int) -> DataFrame:
    """Streaming entries (url, arrival, fetched_at, ...) whose URL is neither in ``known`` nor was seen before.

    Entries fetched more than ``days`` before the newest one come too late and are dropped.
    """
    schema = entries.schema
    cut = entries.mapInPandas(earliest("url", ["arrival"], 1), schema).join(known.select("url"), "url", "left_anti").select(*schema.names)
    return cut.withWatermark("fetched_at", f"{days} days").groupBy("url").transformWithStateInPandas(
        FirstOfUrl(days), schema, "Append", "EventTime"
    )


def _step(held: Column, ok: Column) -> Column:
    """State and counter after one outcome: a success starts the next stage at 0, the third failure at a stage is final."""
    after = dict(zip(STAGES, [*STAGES[1:], C.NEXT_STATE[STAGES[-1]]]))
    failed = {stage: C.FAILED_STATE.get(stage, "failed_analyze") for stage in STAGES}
    of = lambda states: F.element_at(F.create_map(*[F.lit(x) for item in states.items() for x in item]), held["processing_state"])
    tried = held["attempts"] + 1
    return (
        F.when(~held["processing_state"].isin(STAGES), held)
        .when(ok, F.struct(of(after).alias("processing_state"), F.lit(0).cast("long").alias("attempts")))
        .otherwise(F.struct(F.when(tried >= C.MAX_ATTEMPTS, of(failed)).otherwise(held["processing_state"]).alias("processing_state"), tried.alias("attempts")))
    )


def advanced(current: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(article_id, processing_state, attempts) of the articles in ``outcomes`` (article_id, at, seq, ok), going on from ``current``.

    All articles of a batch advance in one native fold; a Python call for each took milliseconds an article.
    """
    rows = outcomes.select("article_id", F.unix_micros("at").alias("at"), "seq", "ok")
    cut = rows.mapInPandas(earliest("article_id", ["at", "seq"], SETTLING), rows.schema)
    # Rows without a time or number come last.
    place = F.struct(F.col("at").isNull().alias("a"), "at", F.col("seq").isNull().alias("s"), "seq", F.coalesce("ok", F.lit(False)).alias("ok"))
    seen = cut.groupBy("article_id").agg(F.slice(F.sort_array(F.collect_list(place)), 1, SETTLING).alias("seen"))
    held = current.select(F.col("article_id").alias("known"), F.struct("processing_state", "attempts").alias("held"))
    first = F.struct(F.lit(STAGES[0]).alias("processing_state"), F.lit(0).cast("long").alias("attempts"))
    both = seen.join(held, F.col("article_id").eqNullSafe(F.col("known")), "left")
    after = F.aggregate("seen", F.coalesce("held", first), lambda state, x: _step(state, x["ok"]))
    return both.select("article_id", after.alias("after")).select("article_id", "after.processing_state", "after.attempts")


def due_stories(articles: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Streaming articles -> stories each batch touches that are due for a (new) comparison."""
    ready = articles.where("story_id is not null and outlet_id is not null and processing_state in ('analyzed', 'complete')")
    analysed = F.when(F.col("processing_state") == "analyzed", F.unix_micros("state_updated_at"))
    known = comparisons.groupBy("story_id").agg(F.max(F.unix_micros("generated_at")).alias("generated"))
    rows = ready.join(known, "story_id", "left").select(
        "story_id", "outlet_id", F.lit(1).cast("long").alias("articles"), F.coalesce(analysed, F.lit(-1).cast("long")).alias("latest"),
        F.coalesce("generated", F.lit(-1).cast("long")).alias("compared"),
    )
    parts = rows.mapInPandas(outlet_parts, "story_id long, outlet_id long, articles long, latest long, compared long")
    return parts.groupBy("story_id").transformWithStateInPandas(
        StoryReadiness(), "story_id long, n_articles long, n_outlets long, latest long", "Append", "None"
    )
