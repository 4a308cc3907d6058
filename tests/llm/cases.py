"""Frames with the awkward cases every operator must stand, and brute-force helpers."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, kept boolean, hash string"

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
AWKWARD = [
    (1, BASE, "en", "src0"),
    (2, BASE, None, "src0"),  # a copy
    (2, BASE, None, "src0"),  # a repeated row
    (3, BASE.replace(" ", " \n\t"), "en", None),  # equal but for white space
    (4, None, "en", "src1"),
    (5, "", None, None),
    (6, "   \n\t ", "en", "src1"),
    (7, "short", "en", "src1"),
    (8, "été 日本語 " + BASE.upper(), "fr", "src1"),
    (9, "lead in " + BASE + " and out\n" + BASE + "\nlast line", "en", "src0"),
    (None, BASE, "en", "src0"),
    (None, "only here without id", "en", "src0"),
    (10, "x" * 3000, "en", "src0"),
    (11, "word " * 4000, "en", "src0"),
    (12, "### $$$ %%% " * 30, "de", "src2"),
]


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source), with more columns that clash with inner names."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 5, False, "x") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def near_texts(seed: int, groups: int, copies: int, length: int = 60, edits: int = 3, vocabulary: int = 4000):
    """Texts in groups of edited copies, plus passages that unrelated texts share."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(20)]
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(length // 2, length * 2))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(vocabulary)}"
            if rng.random() < 0.3:
                own[3:3] = passage
            out.append(" ".join(own))
    rng.shuffle(out)
    return list(enumerate(out))


def union(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
