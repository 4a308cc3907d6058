"""Byte-level BPE: a streaming transducer with computed lookahead for long runs, and a batch encoder for short ones.

A merge list turns a byte run into tokens by applying its rules in order of rank.  Two texts that share a prefix can
only differ in their tokens close to the end of that prefix: a rule ``(u, v)`` that joins across the border moves it
left by ``len(u)``, and a later rule can only do so again if ``u`` starts its right part.  The longest such chain,
found by one pass over the merge list, is the *sufficient lookahead*: tokens that end so many bytes before the last
byte read are final, whatever follows.  So a run of any length is encoded with a buffer of constant size.

The split of text into runs follows the byte-level pre-tokenizer: contractions, letters, numbers, other signs, spaces.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pressgrid.llm import words as W

# The pre-tokenizer's pattern and its sign classes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CLASSES = {"letter": r"\p{L}*", "number": r"\p{N}*", "space": r"\s*", "other": r"[^\s\p{L}\p{N}]*"}

OPEN_RUN = 1 << 16  # characters of one unfinished run from which on it is streamed
CACHED_PIECES = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, then from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge rules and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = stored["model"]["vocab"]
        self.tokens: dict[int, bytes] = {number: as_bytes(token) for token, number in vocab.items()}
        self.bytes_to_id = {data: number for number, data in self.tokens.items()}
        self.added = {token["content"]: token["id"] for token in stored.get("added_tokens", [])}
        for text, number in self.added.items():
            self.tokens[number] = text.encode()
        self.single = [self.bytes_to_id[bytes([b])] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # token of each rank
        self.left: dict[int, int] = {}
        for rank, merge in enumerate(stored["model"]["merges"]):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            u, v, whole = vocab[u], vocab[v], vocab[u + v]
            if whole in self.left or any(len(self.tokens[t]) > 1 and t not in self.left for t in (u, v)):
                raise ValueError(f"merge {rank} breaks the order of the merge list")
            self.left[whole] = u
            self.ranks[u, v] = rank
            self.made.append(whole)
        self.never = len(self.made)
        self.size = max(self.tokens) + 1
        self.single_table, self.made_table = np.array(self.single, np.int64), np.array(self.made, np.int64)
        self.tables = self._rank_tables()
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        """Bytes after which no continuation can change a token's end: the heaviest chain of border-moving rules."""
        heaviest: dict[int, int] = {}
        for u, v in self.ranks:  # in order of rank
            longest, part = 0, v
            while part is not None:
                longest = max(longest, heaviest.get(part, 0))
                part = self.left.get(part)
            heaviest[u] = max(heaviest.get(u, 0), longest + len(self.tokens[u]))
        return max(heaviest.values(), default=0)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one run that is held whole."""
        if len(data) >= 200:
            return self._merged_by_heap(data)
        single, ranks, never = self.single, self.ranks, self.never
        parts = [single[b] for b in data]
        order = [ranks.get(pair, never) for pair in zip(parts, parts[1:])]
        while order and (best := min(order)) != never:
            k = order.index(best)
            parts[k : k + 2] = [self.made[best]]
            del order[k]
            if k:
                order[k - 1] = ranks.get((parts[k - 1], parts[k]), never)
            if k < len(order):
                order[k] = ranks.get((parts[k], parts[k + 1]), never)
        return parts

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, ``never`` where they don't join."""
        keys = left * self.size + right
        found = np.full(len(keys), self.never, np.int64)
        for factor, shift, known, rank in self.tables:
            slot = ((keys * factor) >> shift) & (len(known) - 1)
            found = np.where(known[slot] == keys, rank[slot], found)
        return found

    def _rank_tables(self) -> list[tuple]:
        """Hash tables without chains: pairs that meet in one table go to the next."""
        pairs = np.array(list(self.ranks), np.int64)
        keys, ranks = pairs[:, 0] * self.size + pairs[:, 1], np.arange(len(pairs))
        tables, bits = [], 19
        for factor in W.random_row(64, 5).astype(np.int64):
            known, rank = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
            slot = ((keys * factor) >> 30) & (len(known) - 1)
            known[slot[::-1]], rank[slot[::-1]] = keys[::-1], ranks[::-1]
            tables.append((factor, 30, known, rank))
            left = known[slot] != keys
            keys, ranks, bits = keys[left], ranks[left], max(8, bits - 4)
            if not len(keys):
                return tables
        raise ValueError("the merge list has pairs that can't be told apart")

    def merge_many(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per run) of many short runs laid end to end: each round makes every run's next merge."""
        never = self.never
        tokens, sizes = self.single_table[data], lengths.copy()
        run = np.repeat(np.arange(len(lengths)), lengths)
        done_tokens, done_run = [], []
        ranks = np.full(len(tokens), never, np.int64)
        joined = np.flatnonzero(run[1:] == run[:-1])
        ranks[joined] = self.pair_ranks(tokens[joined], tokens[joined + 1])
        while len(tokens):
            begin = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
            size = np.diff(np.append(begin, len(run)))
            least = np.minimum.reduceat(ranks, begin)
            open_run = np.repeat(least < never, size)
            if not open_run.all():
                done_tokens.append(tokens[~open_run])
                done_run.append(run[~open_run])
                tokens, run, ranks = tokens[open_run], run[open_run], ranks[open_run]
                least, size = least[least < never], size[least < never]
                if not len(tokens):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, size))
            at = at[np.concatenate(([True], run[at[1:]] != run[at[:-1]]))]  # the leftmost in each run
            tokens[at] = self.made_table[least]
            keep = np.ones(len(tokens), bool)
            keep[at + 1] = False
            tokens, run, ranks = tokens[keep], run[keep], ranks[keep]
            at = at - np.arange(len(at))
            for k in (at, at[at > 0] - 1):
                ranks[k] = never
                k = k[k + 1 < len(tokens)]
                k = k[run[k] == run[k + 1]]
                ranks[k] = self.pair_ranks(tokens[k], tokens[k + 1])
        tokens = np.concatenate(done_tokens) if done_tokens else np.empty(0, np.int64)
        run = np.concatenate(done_run) if done_run else np.empty(0, np.int64)
        order = np.argsort(run, kind="stable")
        return tokens[order].astype(np.uint32), np.bincount(run, minlength=len(sizes)).astype(np.int64)

    def _merged_by_heap(self, data: bytes) -> list[int]:
        parts = [self.single[b] for b in data]
        n = len(parts)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(self.ranks[p], k, p) for k, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapify(queue)
        while queue:
            _, k, pair = heappop(queue)
            after = following[k]
            if after >= n or (parts[k], parts[after]) != pair:
                continue
            parts[k], parts[after] = self.made[self.ranks[pair]], -1
            following[k] = far = following[after]
            if far < n:
                before[far] = k
            for one, two in ((before[k], k), (k, far)):
                if one >= 0 and two < n and (new := (parts[one], parts[two])) in self.ranks:
                    heappush(queue, (self.ranks[new], one, new))
        return [t for t in parts if t >= 0]


class RunTransducer:
    """Tokens of one run whose bytes come bit by bit; holds at most the lookahead and one block."""

    BLOCK = 1024

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held = vocabulary, b""

    def feed(self, data: bytes) -> Iterator[int]:
        vocabulary = self.vocabulary
        for low in range(0, len(data), self.BLOCK):
            self.held += data[low : low + self.BLOCK]
            final, end = len(self.held) - vocabulary.lookahead, 0
            if final <= 0:
                continue
            for token in vocabulary.merge(self.held):
                if end + len(vocabulary.tokens[token]) > final:
                    break
                end += len(vocabulary.tokens[token])
                yield token
            self.held = self.held[end:]

    def finish(self) -> Iterator[int]:
        held, self.held = self.held, b""
        yield from self.vocabulary.merge(held) if held else ()


class StreamEncoder:
    """Token ids of a text that comes in parts, emitted once stable; memory does not grow with the text."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(SPLIT)
        self.classes = {name: regex.compile(pattern) for name, pattern in CLASSES.items()}
        self.markers = regex.compile("|".join(map(regex.escape, vocabulary.added))) if vocabulary.added else None
        self.hold = max([3, *(len(x) for x in vocabulary.added)])
        self.pending, self.run, self.kind = "", None, ""

    def feed(self, text: str) -> Iterator[int]:
        self.pending += text
        yield from self._take(last=False)

    def finish(self) -> Iterator[int]:
        yield from self._take(last=True)

    def _take(self, last: bool) -> Iterator[int]:
        while self.markers and (found := self.markers.search(self.pending)):
            before, self.pending = self.pending[: found.start()], self.pending[found.end() :]
            yield from self._segment(before, True)
            yield self.vocabulary.added[found.group()]
        before, self.pending = self.pending, ""
        self.pending = yield from self._segment(before, last)

    def _segment(self, text: str, last: bool) -> Iterator[int]:
        """Encode what is settled of ``text``; return the rest."""
        if self.run is not None:
            end = self.classes[self.kind].match(text).end()
            over = last or end < len(text) - self.hold
            take = end if over else max(0, min(end, len(text) - self.hold))
            if self.kind == "space" and take == end and end and end < len(text):
                take -= 1  # the last space before a sign stays out of the run
            yield from self.run.feed(text[:take].encode())
            text = text[take:]
            if not over:
                return text
            yield from self.run.finish()
            self.run = None
        runs = [m.span() for m in self.split.finditer(text)]
        if not last:
            settled = len(text) - self.hold
            while runs and (runs[-1][1] > settled or runs[-1][1] == len(text)):
                runs.pop()
            if runs and text[runs[-1][1] - 1].isspace():
                runs.pop()
        for low, high in runs:
            yield from self.vocabulary.merge(text[low:high].encode()) if high - low < OPEN_RUN else self._long(text[low:high])
        text = text[runs[-1][1] if runs else 0 :]
        if not last and len(text) > OPEN_RUN:
            first = self.split.match(text)
            body = text[1] if text[0] == " " and len(text) > 1 else text[0]
            kind = next(name for name in ("letter", "number", "other", "space") if self.classes[name].match(body).end())
            if first.end() > self.hold + 1 and not (kind == "space" and first.end() < len(text)):
                take = min(first.end(), len(text) - self.hold) - 1
                self.run, self.kind = RunTransducer(self.vocabulary), kind
                yield from self.run.feed(text[:take].encode())
                text = text[take:]
        return text

    def _long(self, run: str) -> Iterator[int]:
        stream = RunTransducer(self.vocabulary)
        for low in range(0, len(run), OPEN_RUN):
            yield from stream.feed(run[low : low + OPEN_RUN].encode())
        yield from stream.finish()


class StreamDecoder:
    """Text of token ids that come in parts: holds only the bytes of an unfinished character.

    Bytes that are no UTF-8 become U+FFFD, as in a lossy decoder.  Ids outside the vocabulary give nothing.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join(self.tokens.get(i, b"") for i in ids))

    def feed_bytes(self, data: bytes) -> str:
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


class BatchEncoder:
    """Ids of many texts at once.

    Texts are cut at white space into pieces that encode alike wherever they stand; each distinct piece is
    encoded once while a cache of bounded size holds it, and the ids of a slice are gathered from the cache.  Runs under
    two transducer blocks are merged whole, all of a batch together; only longer ones go through the transducer.  The
    ids of one slice are held at a time.
    The gathered token bytes are compared with the input, so a clash of piece hashes can't go unseen.
    Texts with other white space than ASCII's or with added tokens take the streaming encoder, as do very long ones.
    """

    LONG = 4 << 20

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(SPLIT)
        size = max(self.vocabulary.tokens) + 1
        data = [self.vocabulary.tokens.get(i, b"") for i in range(size)]
        self.token_length = np.fromiter(map(len, data), np.int64, size)
        self.token_begin = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.marks = [m.encode() for m in self.vocabulary.added]
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.begin, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def _add(self, keys: list[int], pieces: list[bytes]) -> None:
        """Encode new pieces and keep their ids."""
        ids, counts = self._encode(pieces)
        at = len(self.slots)
        while at + len(keys) > len(self.begin):
            self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.begin[at : at + len(keys)] = self.used + np.cumsum(counts) - counts
        self.length[at : at + len(keys)] = counts
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.slots.update(zip(keys, range(at, at + len(keys))))

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids per piece) of pieces; words and white space are never mixed but for one blank before a word."""
        spaces = [p.isspace() for p in pieces]
        # A line break after each word piece splits off as a run of its own and marks the piece's end.
        joined = "".join(p.decode() + "\n" for p, blank in zip(pieces, spaces) if not blank)
        runs, of_run, k = [], [], 0
        words = [k for k, blank in enumerate(spaces) if not blank]
        for run in self.split.findall(joined):
            if run == "\n":
                k += 1
            else:
                runs.append(run.encode())
                of_run.append(words[k])
        for k, blank in enumerate(spaces):
            if blank:
                runs.append(pieces[k])
                of_run.append(k)
        order = np.argsort(np.array(of_run), kind="stable")
        short = 2 * RunTransducer.BLOCK
        whole = b"".join(r if len(r) < short else b"" for r in runs)
        ids, counts = self.vocabulary.merge_many(
            np.frombuffer(whole, np.uint8), np.fromiter((len(r) if len(r) < short else 0 for r in runs), np.int64, len(runs))
        )
        begins = np.cumsum(counts) - counts
        for k, run in enumerate(runs):
            if len(run) >= short:
                stream = RunTransducer(self.vocabulary)
                own = np.array([*stream.feed(run), *stream.finish()], np.uint32)
                begins[k], counts[k] = len(ids), len(own)
                ids = np.concatenate((ids, own))
        per_piece = np.bincount(of_run, weights=counts, minlength=len(pieces)).astype(np.int64)
        return W.gather(ids, begins[order], counts[order]), per_piece

    def stream(self, data: np.ndarray) -> np.ndarray:
        """Ids of one text through the streaming encoder."""
        encoder, decoder = StreamEncoder(self.vocabulary), codecs.getincrementaldecoder("utf-8")()
        parts = []
        for low in range(0, len(data), OPEN_RUN):
            parts.append(np.fromiter(encoder.feed(decoder.decode(data[low : low + OPEN_RUN].tobytes())), np.uint32))
        parts.append(np.fromiter(encoder.finish(), np.uint32))
        return np.concatenate(parts)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return W.gather(self.token_bytes, self.token_begin[ids], self.token_length[ids])

    def _unusual(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows with non-ASCII white space or an added token."""
        at = [np.empty(0, np.int64)]
        d, n = data, len(data)
        if (d >= 0xC2).any():
            two, three = np.flatnonzero(d == 0xC2), np.flatnonzero((d >= 0xE1) & (d <= 0xE3))
            after = d[np.minimum(two + 1, n - 1)]
            at.append(two[(after == 0x85) | (after == 0xA0)])
            a, b = d[np.minimum(three + 1, n - 1)], d[np.minimum(three + 2, n - 1)]
            lead = d[three]
            at.append(three[((lead == 0xE1) & (a == 0x9A) & (b == 0x80)) | ((lead == 0xE3) & (a == 0x80) & (b == 0x80))])
            blanks = (b <= 0x8A) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF)
            at.append(three[(lead == 0xE2) & (((a == 0x80) & blanks) | ((a == 0x81) & (b == 0x9F)))])
        whole = data.tobytes()
        for mark in self.marks:
            found = whole.find(mark)
            while found >= 0:
                at.append(np.array([found]))
                found = whole.find(mark, found + 1)
        return np.unique(np.searchsorted(offsets, np.concatenate(at), side="right") - 1)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, row) of the pieces of ordinary texts, in order: a word with the blank before it, or white space."""
        words = W.find_words(data, offsets)
        starts, ends, row = words
        first = np.ones(len(starts), dtype=bool)
        first[1:] = row[1:] != row[:-1]
        gap = np.where(first, offsets[row], np.concatenate(([0], ends[:-1]))) if len(starts) else starts
        blank = (starts > gap) & (data[np.maximum(starts - 1, 0)] == 32)
        own = starts - blank
        # White space before a word, without the blank that goes with it: all but its last sign, then that sign.
        lone = own > gap
        cut = np.where(blank | (own - gap == 1), own, own - 1)
        tail = np.ones(len(starts), dtype=bool)
        tail[:-1] = row[1:] != row[:-1]
        left = offsets[:-1].copy()
        left[row[tail]] = ends[tail]
        trailing = left < offsets[1:]
        rows = np.arange(len(left))
        begin = np.concatenate((own, gap[lone], cut[lone & (cut < own)], left[trailing]))
        end = np.concatenate((ends, cut[lone], own[lone & (cut < own)], offsets[1:][trailing]))
        of = np.concatenate((row, row[lone], row[lone & (cut < own)], rows[trailing]))
        order = np.argsort(begin, kind="stable")
        return begin[order], end[order], of[order]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        begin, end, row = self.pieces(data, offsets)
        if not len(begin):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        keys, firsts, inverse = np.unique(W.hash_spans(data, begin, end), return_index=True, return_inverse=True)
        if len(self.slots) + len(keys) > CACHED_PIECES:
            self._forget()
        listed = keys.tolist()
        new = [k for k, key in enumerate(listed) if key not in self.slots]
        if new:
            spans = zip(begin[firsts[new]].tolist(), end[firsts[new]].tolist())
            whole = data.tobytes()
            self._add([listed[k] for k in new], [whole[low:high] for low, high in spans])
        slots = np.fromiter(map(self.slots.__getitem__, listed), np.int64, len(listed))
        of_piece = slots[inverse]
        ids = W.gather(self.pool, self.begin[of_piece], self.length[of_piece])
        if not np.array_equal(self.bytes_of(ids), data):
            return None
        counts = np.bincount(row, weights=self.length[of_piece], minlength=len(offsets) - 1).astype(np.int64)
        return ids, counts

    def slice_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids per row) of one slice of texts."""
        odd = self._unusual(data, offsets) if len(data) else np.empty(0, np.int64)
        if not len(odd) and len(data) <= self.LONG and (found := self._plain(data, offsets)) is not None:
            return found
        parts, counts = [np.empty(0, np.uint32)], []
        special = set(odd.tolist())
        for k in range(len(offsets) - 1):
            own = data[offsets[k] : offsets[k + 1]]
            plain = None if k in special or len(own) > self.LONG else self._plain(own, np.array([0, len(own)]))
            parts.append(self.stream(own) if plain is None else plain[0])
            counts.append(len(parts[-1]))
        return np.concatenate(parts), np.array(counts, np.int64)


def decimal_hash_inputs(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool, begins and lengths of ``"<id>,"`` for ids under ``size``."""
    written = [b"%d," % i for i in range(size)]
    lengths = np.fromiter(map(len, written), np.int64, size)
    return np.frombuffer(b"".join(written), np.uint8), np.cumsum(lengths) - lengths, lengths


def round_trip_digests(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode each whole text, decode the ids again, and return digests of both.

    doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded text in UTF-8).
    Null text counts as empty, which has no ids; repeated rows give repeated rows; an empty table gives none; other
    columns are ignored.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        encoder = BatchEncoder(vocabulary_path)
        pool, begins, lengths = decimal_hash_inputs(len(encoder.token_length))
        for batch in batches:
            for low, high, data, offsets in W.text_slices(batch.column("text")):
                ids, counts = encoder.slice_ids(data, offsets)
                ends = np.cumsum(counts)
                numbers, decoded = [], []
                for first, end in zip((ends - counts).tolist(), ends.tolist()):
                    written, text = sha256(), sha256()
                    state = StreamDecoder(encoder.vocabulary)
                    for at in range(first, end, OPEN_RUN):  # both digests go on in parts of bounded size
                        part = ids[at : min(at + OPEN_RUN, end)]
                        decimal = W.gather(pool, begins[part], lengths[part])
                        written.update(decimal[: len(decimal) - (at + OPEN_RUN >= end)].tobytes())
                        text.update(state.feed_bytes(encoder.bytes_of(part).tobytes()).encode())
                    text.update(state.finish().encode())
                    numbers.append(written.hexdigest())
                    decoded.append(text.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(counts), pa.array(numbers), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        digest, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
