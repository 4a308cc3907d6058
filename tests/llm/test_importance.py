import hashlib
import math
import random
import re
import zlib
from collections import Counter

import cases
import numpy as np
import pytest

from pressgrid.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_run=1):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    return len(words), [" ".join(words[k : k + run]) for run in range(1, max_run + 1) for k in range(len(words) - run + 1)]


def brute(documents, targets, buckets=10_000, max_run=1, min_words=20, percent=10):
    """Rows of the draw by one plain loop per document."""

    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    corpus, wanted = (Counter(bucket(f) for t in texts for f in features(t, max_run)[1]) for texts in ([t for _, t in documents], targets))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())

    def gain(b):
        return math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + buckets) / ((corpus[b] + 1.0) * (t_all + buckets))))

    rows = []
    for i, t in documents:
        n_words, own = features(t, max_run)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0]))
    drawn = [(i, n, w, s, k + 1) for k, (i, _, n, w, s) in enumerate(able[: percent * len(able) // 100])]
    left = [(i, n, w, s, None) for i, _, n, w, s in able[len(drawn) :]] + [(i, n, w, s, None) for i, m, n, w, s in rows if m < min_words]
    return sorted(drawn + left, key=repr)


def test_crc_of_spans():
    rng = random.Random(3)
    data = np.frombuffer(rng.randbytes(70_000), dtype=np.uint8)
    spans = [(rng.randrange(60_000), rng.choice([0, 1, 2, 7, 63, 64, 65, 127, 128, 129, 1000, 9999])) for _ in range(400)] + [(0, 70_000), (5, 0)]
    starts, lengths = (np.array(x) for x in zip(*spans))
    got = importance.crc_spans(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in spans]
    assert importance.crc_spans(data, starts[:0], lengths[:0]).tolist() == []


@pytest.mark.parametrize("max_run", [1, 3])
def test_awkward_rows(spark, max_run):
    target = spark.createDataFrame([(1, cases.BASE), (2, None), (3, "Été 日本語 SHORT")], "item_id long, text string")
    long_word = [(20, "é" * 5000 + " " + cases.BASE, "en", "a"), (21, "a.B-c_d 9" * 20, None, None)]
    rows = cases.AWKWARD + long_word
    got = importance.importance_draw(cases.frame(spark, rows), target, max_run=max_run, percent=50).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(i, t) for i, t, _, _ in rows], [r.text for r in target.collect()], max_run=max_run, percent=50)
    assert importance.importance_draw(cases.empty(spark), target).collect() == []
    none = importance.importance_draw(cases.frame(spark, rows), target.where("false"), max_run=max_run).collect()
    assert len(none) == len(rows)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    targets = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = queries.op12_importance(spark, folder).collect()
    assert sorted(map(tuple, got), key=repr) == brute(documents, targets)
