"""Full-text search: stored inverted index, matching, ranking, snippets.

Terms are lowered alphanumeric runs, without English stop words, under a light
suffix rule (functions.text.stem).  An article matches when every query term
occurs in headline or body.  rank = sum over query terms of
tf / (tf + 1.2) * ln(1 + articles / articles with the term), rounded to 6 places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pressgrid import constants as C
from pressgrid.functions import text
from pressgrid.operators.filters import bounded
from pressgrid.session import folder_done

SATURATION = 1.2
SNIPPET_WORDS = 30
SNIPPET_LEAD = 14
BUCKETS = 64
SHAPES = {
    "postings": "term string, block long, offsets array<int>, tfs array<long>, bucket int",
    "terms": "term string, df long, bucket int",
}
BLOCK_IDS = 1 << 16  # ids a block of postings spans, and so the most it holds


def document_text() -> Column:
    return F.concat_ws(" ", F.coalesce("headline", F.lit("")), F.coalesce("full_text", F.lit("")))


def _runs(words: Column) -> Column:
    """array<struct<term, tf>> of a sorted array: where each run of equal words begins, and how long it is."""

    def lengths(w: Column) -> Column:
        begins = F.filter(F.transform(w, lambda x, i: F.when(F.coalesce(F.get(w, i - 1) != x, F.lit(True)), i)), lambda i: i.isNotNull())
        return F.transform(F.array(begins), lambda at: F.transform(
            at, lambda i, k: F.struct(F.get(w, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).cast("long").alias("tf"))
        ))[0]

    return F.transform(F.array(words), lengths)[0]


def fts_tokens(articles: DataFrame) -> DataFrame:
    """(article_id, term, tf) over whole headlines and bodies; counted inside each row, so nothing is exchanged.

    The outer form of inline keeps the optimizer from adding a test of the
    array's size, which would split every text twice.
    """
    words = F.filter(text.raw_terms(document_text()), lambda w: ~text.is_stop_word(w))
    terms = F.array_sort(F.transform(words, text.stem))
    return articles.select("article_id", F.inline_outer(_runs(terms))).where("term is not null")


@dataclass
class SearchIndex:
    """Stored postings: ``postings`` (bucket, term, block, offsets, tfs), ``terms`` (bucket, term, df), ``size`` (n).

    A bucket holds the terms of one hash; a block the postings of a term in one range of ``BLOCK_IDS`` article ids, with ids as offsets
    from its first, in rising order.
    """

    spark: SparkSession
    path: str

    def _of(self, name: str, terms: list[str]) -> DataFrame:
        """Rows of some terms; other buckets are not read, and row groups are skipped by term."""
        held = self.spark.read.schema(SHAPES[name]).parquet(f"{self.path}/{name}")
        if not terms:
            return held.where(F.lit(False))
        buckets = [r.b for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket().alias("b")).distinct().collect()]
        return held.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def postings(self, terms: list[str]) -> DataFrame:
        """(article_id, term, tf) in the blocks that hold every term."""
        rows = self._of("postings", terms)
        whole = rows.groupBy("block").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") == len(terms)).select("block")
        pairs = F.arrays_zip(F.col("offsets").alias("offset"), F.col("tfs").alias("tf"))
        met = rows.join(whole, "block").select("block", "term", F.inline(pairs))
        return met.select((F.col("block") * BLOCK_IDS + F.col("offset")).alias("article_id"), "term", "tf")

    def weights(self, terms: list[str]) -> dict[str, float]:
        """ln(1 + articles / articles with the term) of the terms that occur; one row per query term."""
        n = self.spark.read.parquet(f"{self.path}/size").first().n
        weight = F.log(1 + F.lit(float(n)) / F.col("df"))
        return {r.term: r.weight for r in self._of("terms", terms).select("term", weight.alias("weight")).collect()}


def _bucket() -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")


PART_POSTINGS = 1 << 21  # postings a task holds before it passes them on: 32 MB
NO_ID = -(1 << 62)  # stands for a null id, which counts for its terms and is never found


def _part_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, block, ids, tfs) of some articles from (article_id, words); a term has a row per task and block, or a few.

    Each distinct word of a batch is looked at once; counting and sorting run on numbers.
    """
    known: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows() -> pa.RecordBatch:
        term, article, tf = (np.concatenate(x) for x in zip(*held))
        block = article // BLOCK_IDS
        order = np.lexsort((article, block, term))
        term, article, block, tf = term[order], article[order], block[order], tf[order]
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        begin = np.flatnonzero(new)
        ends = pa.array(np.append(begin, len(term)), pa.int32())
        offsets = (article - block * BLOCK_IDS).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(known)).take(pa.array(term[begin])), pa.array(block[begin], mask=block[begin] == NO_ID // BLOCK_IDS), pa.ListArray.from_arrays(ends, pa.array(offsets)), pa.ListArray.from_arrays(ends, pa.array(tf))],
            names=["term", "block", "offsets", "tfs"],
        )

    for batch in batches:
        words = batch.column("words")
        coded = words.flatten().dictionary_encode()
        roots = np.array([known.setdefault(_root(w), len(known)) if w and w not in C.STOP_WORDS else -1 for w in coded.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
        term = roots[coded.indices.to_numpy()] if len(roots) else np.empty(0, np.int64)
        row, term = row[term >= 0], term[term >= 0]
        found, tf = np.unique(term * len(words) + row, return_counts=True)
        held.append((found // len(words), batch.column("article_id").fill_null(NO_ID).to_numpy()[found % len(words)], tf.astype(np.int64)))
        if sum(len(x) for x, _, _ in held) >= PART_POSTINGS:
            yield rows()
            held, known = [], {}
    if sum(len(x) for x, _, _ in held):
        yield rows()


def _whole_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per term and block, its ids rising, from rows sorted by term and block."""

    def merged(rows: pa.RecordBatch, begin: np.ndarray) -> pa.RecordBatch:
        lengths = rows.column("offsets").value_lengths().to_numpy().astype(np.int64)
        sizes = np.add.reduceat(lengths, begin)
        offsets, tfs = (rows.column(c).flatten().to_numpy() for c in ("offsets", "tfs"))
        order = np.lexsort((tfs, offsets, np.repeat(np.arange(len(begin)), sizes)))
        ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (offsets, tfs)]
        one = rows.select(["term", "block", "bucket"]).take(pa.array(begin))
        return pa.RecordBatch.from_arrays([one.column("term"), one.column("block"), *lists, one.column("bucket")], names=["term", "block", "offsets", "tfs", "bucket"])

    rest: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if rest is None else pa.concat_batches([rest, batch])
        term, block = rows.column("term"), rows.column("block").fill_null(NO_ID).to_numpy()
        other = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False).astype(bool) | (block[1:] != block[:-1])
        begin = np.concatenate(([0], np.flatnonzero(other) + 1))
        if len(begin) > 1:
            yield merged(rows.slice(0, begin[-1]), begin[:-1])
        rest = rows.slice(begin[-1])
    if rest is not None:
        yield merged(rest, np.zeros(1, np.int64))


def build_index(articles: DataFrame, path: str) -> SearchIndex:
    """Write the index of ``articles`` to ``path``; a finished one there is taken as it is.

    A task puts its articles' postings together by term before they are exchanged, so a term crosses the network a few
    times a task and not once an article.  A term in very many articles becomes many blocks, each of bounded size.
    """
    spark = articles.sparkSession
    if not folder_done(spark, f"{path}/size"):
        words = F.split(F.lower(document_text()), text.WORD_BREAK)
        parts = articles.select(F.col("article_id").cast("long").alias("article_id"), words.alias("words")).mapInArrow(
            _part_postings, "term string, block long, offsets array<int>, tfs array<long>"
        )
        dealt = parts.withColumn("bucket", _bucket()).repartition("bucket").sortWithinPartitions("bucket", "term", "block")
        dealt.mapInArrow(_whole_postings, SHAPES["postings"]).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        counts = spark.read.schema(SHAPES["postings"]).parquet(f"{path}/postings").groupBy("bucket", "term").agg(F.sum(F.size("offsets")).alias("df"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        articles.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/size")
    return SearchIndex(spark, path)


def _root(word: str) -> str:
    """The suffix rule (functions.text.stem) on one word."""
    for tail, least, put in (("ies", 4, "y"), ("ing", 5, ""), ("ed", 4, "")):
        if len(word) > least and word.endswith(tail):
            return word[: -len(tail)] + put
    if len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query (2..200 characters, not blank), by the same rule as documents.

    A query is one short string, so this is plain Python.
    """
    query = query.strip()
    if not 2 <= len(query) <= 200:
        raise ValueError("a query has 2 to 200 characters")

    words = [w for w in re.split(r"[\W_]+", query.lower()) if w and w not in C.STOP_WORDS]
    return list(dict.fromkeys(_root(w) for w in words))


def _root_piece(term: str) -> str:
    """A piece every word with this root holds: the root, or the root without its final y."""
    return term[:-1] if term.endswith("y") else term


def search_match(index: SearchIndex, query: str) -> DataFrame:
    """(article_id, rank) of the articles holding every term."""
    terms = query_terms(query)
    weights = index.weights(terms)
    if len(weights) < len(terms) or not terms:
        return index.spark.createDataFrame([], "article_id long, rank double")
    weight = F.element_at(F.create_map(*[F.lit(x) for item in weights.items() for x in item]), F.col("term"))
    score = F.round(F.sum(F.col("tf") / (F.col("tf") + SATURATION) * weight), 6)
    return (
        index.postings(terms)
        .groupBy("article_id")
        .agg(F.count(F.lit(1)).alias("hits"), score.alias("rank"))
        .where(F.col("hits") == len(terms))
        .select("article_id", "rank")
    )


def search_total(index: SearchIndex, query: str) -> DataFrame:
    return search_match(index, query).agg(F.count(F.lit(1)).alias("total"))


def search_ranked(
    index: SearchIndex, articles: DataFrame, outlets: DataFrame, query: str, page: int = 1, limit: int = 20
) -> DataFrame:
    """One page of hits, best first, with total and has_more.

    Only ids and dates meet before the limit; the page's ids (at most 100) then go into the scan of the articles.
    """
    offset = (bounded("page", page, 10**9) - 1) * bounded("limit", limit, 100)
    matches = search_match(index, query)
    total = matches.agg(F.count(F.lit(1))).scalar()
    hits = (
        matches.join(articles.select("article_id", "published_at"), "article_id")
        .orderBy(F.desc("rank"), F.desc("published_at"), "article_id")
        .offset(offset)
        .limit(limit)
        .select("article_id", "rank")
        .collect()
    )
    shown = index.spark.createDataFrame([tuple(r) for r in hits], "article_id long, rank double")
    rows = (
        articles.where(F.col("article_id").isin([r.article_id for r in hits]) if hits else F.lit(False))
        .select("article_id", "outlet_id", "headline", "url", "published_at", "full_text")
        .join(F.broadcast(shown), "article_id")  # one page of rows
        .join(outlets.select("outlet_id", F.col("slug").alias("outlet_slug")), "outlet_id")
    )
    return (
        with_snippet(rows, F.coalesce("full_text", "headline"), query_terms(query))
        .select("article_id", "outlet_slug", "headline", "url", "published_at", "rank", "snippet", total.alias("total"))
        .withColumn("has_more", F.lit(offset + limit) < F.col("total"))
    )


def with_snippet(df: DataFrame, body: Column, terms: list[str]) -> DataFrame:
    """Add up to 30 words around the first hit, hits in <b></b>; the start when there is no hit."""
    if not terms:
        return df.withColumn("snippet", F.array_join(F.slice(text.words(body), 1, SNIPPET_WORDS), " "))
    wanted = F.array(*[F.lit(t) for t in terms])
    # Most words fail this at once.
    roots = "|".join(re.escape(_root_piece(t)) for t in terms)

    def is_hit(word: Column) -> Column:
        parts = text.raw_terms(word)
        exact = F.exists(parts, lambda p: ~text.is_stop_word(p) & F.array_contains(wanted, text.stem(p)))
        return F.when(F.lower(word).rlike(roots), exact).otherwise(False)

    first = F.array_position("_hits", True)
    start = F.greatest(first - SNIPPET_LEAD, F.lit(1)).cast("int")
    shown = F.zip_with(
        F.slice("_words", start, SNIPPET_WORDS), F.slice("_hits", start, SNIPPET_WORDS),
        lambda w, hit: F.when(hit, F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w),
    )
    return (
        df.withColumn("_words", text.words(body))
        .withColumn("_hits", F.transform("_words", is_hit))
        .withColumn("snippet", F.array_join(shown, " "))
        .drop("_words", "_hits")
    )


def search_snippet(articles: DataFrame, query: str) -> DataFrame:
    """Snippet of every article for a query."""
    rows = articles.select("article_id", F.coalesce("full_text", "headline").alias("_body"))
    return with_snippet(rows, F.col("_body"), query_terms(query)).drop("_body")
