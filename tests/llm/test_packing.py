import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import cases
from pressgrid.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def simple_first_fit(sizes, capacity):
    bins, where = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        at = next((b for b, free in enumerate(bins) if free >= sizes[k]), None)
        if at is None:
            at = len(bins)
            bins.append(capacity)
        where[k] = at, capacity - bins[at]
        bins[at] -= sizes[k]
    return where


def test_tournament_tree_is_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 100, 500):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        want = simple_first_fit(sizes.tolist(), 100)
        assert {k: (b, o) for k, (b, o) in enumerate(zip(bins.tolist(), offsets.tolist()))} == want


def test_every_id_lies_in_one_piece(spark):
    library = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(cases.frame(spark, cases.AWKWARD), PATH, keep_ids=True).collect()
    ids = {}
    for i, text, _, _ in cases.AWKWARD:
        ids.setdefault(i, []).append(np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4"))
    assert sum(r.length for r in rows) == sum(len(x) for own in ids.values() for x in own)
    for r in rows:
        assert any(
            r.doc_tokens == len(x) and x[r.start : r.start + r.length].tobytes() == bytes(r.ids) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
            for x in ids[r.doc_id]
        )
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(cases.empty(spark), PATH).count() == 0
