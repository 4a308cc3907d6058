import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from pressgrid.llm import exact_dedup, fuse


@pytest.mark.parametrize("size", [0, 1, 2, 3, 17, 1000, 30000])
def test_filter_passes_members_and_few_others(size):
    keys = np.random.default_rng(size).integers(0, 2**63, size).astype(np.uint64)
    made = fuse.build(keys)
    assert fuse.might_hold(made, keys).all()
    foreign = np.random.default_rng(size + 1).integers(0, 2**63, 50000).astype(np.uint64)
    assert fuse.might_hold(made, foreign).mean() < 0.01


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("split", ["default", "all", "none", "odd"])
def test_groups(spark, split):
    incoming = {"default": None, "all": F.lit(True), "none": F.lit(False), "odd": F.col("doc_id") % 2 == 1}[split]
    rows = exact_dedup.exact_dedup(cases.frame(spark, cases.AWKWARD), incoming).collect()
    assert len(rows) == len(cases.AWKWARD)
    groups = {}
    for i, text, _, _ in cases.AWKWARD:
        groups.setdefault(hashlib.sha256(normal(text).encode()).hexdigest(), []).append(i)
    seen = {}
    for r in rows:
        ids = groups[r.text_sha256]
        assert r.doc_id in ids and r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
        seen[r.text_sha256] = seen.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(seen.values()) == {1}


def test_distinct_documents(spark):
    kept = exact_dedup.distinct_documents(cases.frame(spark, cases.AWKWARD))
    assert kept.columns == cases.frame(spark, []).columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(t) for _, t, _, _ in cases.AWKWARD})
    assert exact_dedup.exact_dedup(cases.empty(spark)).count() == 0


def test_one_row_of_repeated_rows_stays(spark):
    kept = exact_dedup.distinct_documents(cases.frame(spark, [(1, "a b", "en", "s")] * 3 + [(1, "other", "en", "s")]))
    assert sorted(r.text for r in kept.collect()) == ["a b", "other"]
