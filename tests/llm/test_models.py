import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import cases
from pressgrid.llm import learning, quality_model, queries, toxicity, words as W

DATA = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for query, label, least in ((queries.op1_toxicity, "toxic", 0.85), (queries.op10_quality_model, "quality", 0.95)):
        rows = query(spark, DATA).join(labels, "doc_id").where("held_out").toPandas()
        assert len(rows) > 50 and (rows["predicted"] == rows[label]).mean() > least


def test_labels_of_held_out_rows_are_not_read(spark):
    documents = cases.frame(spark, [(k, f"text {k}", "en", "s") for k in range(100)])
    labels = spark.createDataFrame([(k, k % 2, None if k % 7 == 0 else k % 2) for k in range(100)] + [(None, 1, 1), (3, 0, 0)], LABELS)
    held = {r.doc_id for r in documents.where(learning.held_out(F.col("doc_id"), 5, 0)).collect()}
    rows = learning.training_rows(documents, labels, "toxic", 5, 0).collect()
    assert {r.text for r in rows} == {f"text {k}" for k in range(100) if k not in held and k % 7}
    assert {r.y for r in rows if r.text == "text 3"} == {0}
    assert learning.training_rows(documents, labels, "toxic", 5, 0, limit=10).count() == 10


def test_pairs_of_terms_count():
    """Either term marks a text, both together don't: no sum of single weights can say that."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.45, rng.random() < 0.45
        rows.append(" ".join(["alpha"] * a + ["omega"] * b + [f"w{rng.integers(40)}" for _ in range(6)]))
        y.append(float(a != b))
    data, offsets = W.text_bytes(pa.array(rows))
    row, feature = toxicity.distinct(*toxicity.terms(data, offsets))
    sets = np.split(feature, np.searchsorted(row, np.arange(1, len(rows))))
    found = toxicity.fit(sets, np.array(y))
    assert ((toxicity.scores(found, row, feature, len(rows)) >= 0.5) == np.array(y)).mean() > 0.97


def test_table_model_learns_interactions():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality_model.fit(x, y, rounds=20)
    assert {(a, b) for a, b, _ in model.pairs} >= {(0, 3)}
    assert ((quality_model.scores(model, x) >= 0.5) == y).mean() > 0.97


def test_features_by_hand():
    data, offsets = W.text_bytes(pa.array(["AB ab ab 12!\n#x", None, "", " "]))
    row = dict(zip(quality_model.FEATURES, quality_model.features(data, offsets)[0]))
    assert row["words_log2"] == np.log2(6) and row["word_length"] == 11 / 5 and row["symbols_per_word"] == 0.2
    assert row["upper_share"] == 2 / 7 and row["digit_share"] == 0.4 and row["exclamations_per_word"] == 0.2
    assert row["distinct_share"] == 0.8 and row["adjacent_repeats"] == 0.2 and row["top_share"] == 0.4 and row["breaks_per_word"] == 0.2
    assert not quality_model.features(data, offsets)[1:3].any()


def test_awkward(spark):
    documents = cases.frame(spark, cases.AWKWARD)
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(13)], LABELS)
    for labelled in (labels, labels.limit(0)):
        for rows in (
            toxicity.toxicity(documents, toxicity.train(documents, labelled)).collect(),
            quality_model.quality(documents, quality_model.train(documents, labelled)).collect(),
        ):
            assert len(rows) == len(cases.AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    empty = cases.empty(spark)
    assert toxicity.toxicity(empty, toxicity.train(empty, labels)).count() == 0
    model = quality_model.train(documents, labels.limit(0))
    assert quality_model.good_documents(documents, model).count() == len(cases.AWKWARD)
    assert quality_model.good_documents(empty, quality_model.train(empty, labels)).count() == 0


def test_quality_scores_against_plain_sums(spark):
    """Every document's score is the bias plus one cell per feature and pair, from features counted one text at a time."""
    documents, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    model = quality_model.train(documents, labels)
    assert model.pairs

    def features(text):
        raw = (text or "").encode()
        found = raw.translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)).split(b" ")
        found = [w for w in found if w]
        n, letters = max(len(found), 1), max(sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw), 1)
        share = lambda signs: sum(b in signs for b in raw) / n
        triples = list(zip(found, found[1:], found[2:]))
        return [
            np.log2(len(found) + 1), sum(map(len, found)) / n, share(b"#*$%&|<>"), sum(65 <= b <= 90 for b in raw) / letters, share(b"0123456789"),
            share(b"!"), share(b".,;:?'\"()-"), len(set(found)) / n, sum(x == y for x, y in zip(found, found[1:])) / n,
            max(Counter(found).values(), default=0) / n, sum(b >= 128 for b in raw) / max(len(raw), 1), share(b"\n"),
            (len(triples) - len(set(triples))) / max(len(triples), 1),
        ]

    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r for r in quality_model.quality(documents, model).collect()}
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        x = features(text)
        z = model.bias + sum(t[bisect_left(list(e), v)] for e, t, v in zip(model.edges, model.tables, x))
        z += sum(t[bisect_left(list(model.pair_edges[a]), x[a]), bisect_left(list(model.pair_edges[b]), x[b])] for a, b, t in model.pairs)
        assert abs(got[doc_id].score - 1 / (1 + np.exp(-z))) < 1e-9
        assert got[doc_id].predicted == (got[doc_id].score >= 0.7)


def test_toxicity_scores_against_all_pair_products(spark):
    """Every document's score is the bias, the weights of its terms and the products of all pairs of their factors."""
    documents, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    machine = toxicity.train(documents, labels)
    weight = {f: k for k, f in enumerate(machine.features.tolist())}
    signs, places = (W.random_row(size, seed).tolist() for size, seed in ((256, 12), (1 << 16, 11)))

    def numbers(text):
        words = re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower())
        values, found = {}, set()
        for word in set(words):
            total = 0
            for place, byte in enumerate(word):
                total = (total + signs[byte] * places[place]) % 2**64
                if place + 1 in toxicity.PREFIXES and len(word) > place + 1:
                    values[total + place + 1] = True
            values[total] = True
        for v in values:
            found.add(int(W.mix(np.array([v % 2**64], np.uint64))[0]) >> (64 - toxicity.BITS))
        return sorted(weight[f] for f in found if f in weight)

    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: r.score for r in toxicity.toxicity(documents, machine).collect()}
    assert got.keys() == texts.keys() and len(weight) > 20
    for doc_id, text in texts.items():
        at = numbers(text)
        v = machine.factors[at]
        z = machine.bias + machine.weights[at].sum() + np.triu(v @ v.T, 1).sum()
        assert abs(got[doc_id] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9
