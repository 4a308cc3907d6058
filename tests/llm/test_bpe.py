import hashlib
import random

import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import cases
from pressgrid.llm import bpe, words as W

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "\n", "a\n", " a", "a  b", "a\n\nb", "a \n b", "a\n b  ", "it's we'll 'tis I'd'é", "<|endoftext|>", "a <|endoftext|> b",
    "a  <|endoftext|>  ", "<|endoft", "x  y  　 z", "\x1c\x1d a", "日本語 テキスト 😀😀 x", "123abc!!!???", "a" * 5000, " " * 3000 + "x",
    "ab" * 20000, "\n" * 70000 + "z", "!" * 70000 + "<|endoftext|>" + "q" * 70000, "á\r\n\tb", "٣٤٥ ½ Ⅷ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.BatchEncoder(PATH)


def texts(seed, count):
    rng = random.Random(seed)
    signs = ["a", "b", " ", "'s", "e", "\n", "\t", "é", "1", "!", "<|endoftext|>", "日", " ", "the ", "ing"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(count)]


def test_batch_ids_equal_the_library(encoder, library):
    given = ODD + texts(1, 800)
    found = []
    for _, _, data, offsets in W.text_slices(pa.array(given)):
        ids, counts = encoder.slice_ids(data, offsets)
        ends = counts.cumsum()
        found += [ids[e - c : e].tolist() for c, e in zip(counts, ends)]
    assert found == [x.ids for x in library.encode_batch(given, add_special_tokens=False)]


def test_streaming_ids_do_not_depend_on_the_parts(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "OPEN_RUN", 64)
    rng = random.Random(2)
    for text in ODD + texts(3, 150):
        text = text[:4000]
        stream, got, at = bpe.StreamEncoder(encoder.vocabulary), [], 0
        while at < len(text):
            step = rng.choice([1, 2, 5, 60, 400])
            got += stream.feed(text[at : at + step])
            at += step
        got += stream.finish()
        assert got == library.encode(text, add_special_tokens=False).ids


def test_lookahead_is_sufficient_and_buffer_is_bounded(encoder):
    vocabulary, rng = encoder.vocabulary, random.Random(4)
    assert 0 < vocabulary.lookahead < 2000
    for _ in range(20):
        run = "".join(rng.choice("abcdeinorst") for _ in range(6000)).encode()
        stream, got = bpe.RunTransducer(vocabulary), []
        for at in range(0, len(run), 37):
            got += stream.feed(run[at : at + 37])
            assert len(stream.held) <= vocabulary.lookahead + 64 + stream.BLOCK
        got += stream.finish()
        assert got == vocabulary.merge(run)


def test_decoder_holds_unfinished_characters(encoder):
    ids = encoder.stream(W.text_bytes(pa.array(["naïve 日本 😀"]))[0])
    decoder = bpe.StreamDecoder(encoder.vocabulary)
    assert "".join(decoder.feed([i]) for i in ids.tolist()) + decoder.finish() == "naïve 日本 😀"
    decoder = bpe.StreamDecoder(encoder.vocabulary)
    assert decoder.feed([encoder.vocabulary.single[0xFF], 99999]) + decoder.finish() == "�"


def test_digests(spark, library):
    def want(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        joined = ",".join(map(str, ids)).encode()
        return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    rows = bpe.round_trip_digests(cases.frame(spark, cases.AWKWARD), PATH).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(((i, *want(t)) for i, t, _, _ in cases.AWKWARD), key=repr)
    assert bpe.round_trip_digests(cases.empty(spark), PATH).count() == 0
