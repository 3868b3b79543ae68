"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can stand last in the prefix's encoding. Storing it for every
prefix gives the encoding of all prefixes at once: reading the stored tokens backwards from the end yields the ids, an
append continues from the last prefix, and an edit restarts at its first byte and ends where the stored tokens are the old
ones again. A text's edit splits anew only around the change. A token may follow the token before it if
merging the bytes of both gives just these two; that is remembered per pair of tokens.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm import text as T

CACHE_PIECES, CACHE_PAIRS, LONGEST_KEPT = 300_000, 1 << 18, 64


class Vocabulary:
    """Ranks of byte strings, as in a .tiktoken file: base64 of the bytes, a space, the rank."""

    def __init__(self, lines: list[bytes]):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.length = {v: len(k) for k, v in self.ranks.items()}
        self.longest = max(self.length.values())
        self.pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, ...] | None] = {}
        self.edges: tuple[dict[int, list[tuple[bytes, float]]], ...] = ({}, {})
        self.automaton = ahocorasick.Automaton()
        for k, v in self.ranks.items():
            self.automaton.add_word(k.decode("latin-1"), v)
        self.automaton.make_automaton()

    def merge(self, data: bytes, without: int = -1) -> list[int]:
        """Ids by repeated merging of the pair of least rank, one rank left out; short inputs only."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and r != without and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def split(self, a: int) -> tuple[int, ...] | None:
        """The two tokens whose merge gives the token (none for a single byte); null if merging doesn't lead to it."""
        if a not in self.splits:
            parts = self.merge(self.bytes[a], without=a)
            self.splits[a] = () if self.length[a] == 1 else tuple(parts) if len(parts) == 2 else None
        return self.splits[a]

    def stands(self, a: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return self.split(a) is not None

    def edge(self, a: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the left (0) or right (1) edge of the token while it is merged, each with the rank that ends it."""
        chain, t = [(self.bytes[a], float("inf"))], a
        while parts := self.split(t):
            chain.append((self.bytes[parts[side]], t))
            t = parts[side]
        self.edges[side][a] = chain = chain[::-1]
        return chain

    def follows(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both gives a, b: both edges grow in order of rank, and no merge across comes first."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.stands(b) and self._apart(self.edges[1].get(a) or self.edge(a, 1), self.edges[0].get(b) or self.edge(b, 0))
            if len(self.pairs) < CACHE_PAIRS:
                self.pairs[key] = known
        return known

    def _apart(self, right: list[tuple[bytes, float]], left: list[tuple[bytes, float]]) -> bool:
        ranks, i, j = self.ranks, 1, 1
        (x, x_ends), (y, y_ends) = right[0], left[0]
        while True:
            across = ranks.get(x + y)
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if x_ends <= y_ends:
                if i == len(right):
                    return True
                x, x_ends = right[i]
                i += 1
            else:
                y, y_ends = left[j]
                j += 1

    def extend(self, data: bytes, last: list[int]) -> None:
        """Bring last up to all prefixes of data. Tokens that end at each byte come from one pass of an automaton."""
        base = max(0, len(last) - self.longest + 1)
        length, pairs, follows = self.length, self.pairs, self.follows
        for end, token in self.automaton.iter(data[base:].decode("latin-1")):
            end += base
            if end != len(last):
                if end < len(last):
                    continue
                break
            begin = end + 1 - length[token]
            if begin:
                before = last[begin - 1]
                ok = pairs.get(before << 32 | token)
                if ok or ok is None and follows(before, token):
                    last.append(token)
            elif self.stands(token):
                last.append(token)
        if len(last) != len(data):
            raise ValueError(f"no token ends at byte {len(last) + 1}")

    def read(self, last: list[int]) -> list[int]:
        """The ids of the longest prefix, from its stored last tokens."""
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= self.length[token]
        return out[::-1]


class PrefixEncoder:
    """Encoding of one piece that can grow and change; last[i] is the last token of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.v.extend(self.data, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start to stop by new; returns how many prefixes were worked out again.

        Prefixes before start stay as they are. After the change, once as many stored tokens in a row as the longest
        token has bytes are what they were, all later ones are too: each depends on no more than these.
        """
        before, after = self.last[:start], self.last[stop:]
        self.data, longest = self.data[:start] + new + self.data[stop:], self.v.longest
        self.last, tail = before, start + len(new)
        while len(self.last) < len(self.data):
            self.v.extend(self.data[: max(tail, len(self.last)) + longest], self.last)
            done = len(self.last) - tail
            if done >= longest and self.last[-longest:] == after[done - longest : done]:
                done = len(self.last)
                self.last += after[done - tail :]
                return done - start
        return len(self.last) - start

    def ids(self) -> list[int]:
        return self.v.read(self.last)


class Pieces(dict):
    """Pieces of text to their ids; a piece that is a token itself is that token. The first CACHE_PIECES are kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary

    def __missing__(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.v.ranks.get(data)
        if whole is not None:
            ids: tuple[int, ...] = (whole,)
        else:
            last: list[int] = []
            self.v.extend(data, last)
            ids = tuple(self.v.read(last))
        if len(self) < CACHE_PIECES and len(piece) <= LONGEST_KEPT:
            self[piece] = ids
        return ids


class Encoder:
    """Text to ids and back: each match of the pattern is a piece."""

    def __init__(self, lines: list[bytes], pattern: str):
        self.v, self.pattern = Vocabulary(lines), regex.compile(pattern)
        self.find = self.pattern.findall
        self.pieces = Pieces(self.v)
        self.decimal = {i: str(i) for i in self.v.bytes}

    def encode(self, text: str) -> list[int]:
        return [i for ids in map(self.pieces.__getitem__, self.find(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, ids))

    def text_of(self, ids: list[int]) -> str:
        """Decimal ids, joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids))


class TextEncoder:
    """Encoding of a whole text that can grow and change: pieces far from a change keep their ids.

    Splitting a text goes on from a piece's start whatever stands before it (the pattern looks back at nothing), and looks
    AHEAD characters or a run of white space beyond a piece's end at most.
    """

    AHEAD = 4

    def __init__(self, encoder: Encoder, text: str = ""):
        self.e, self.text = encoder, ""
        self.starts: list[int] = []
        self.pieces: list[tuple[int, ...]] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, stop: int, new: str) -> int:
        """Replace characters start to stop by new; returns how many pieces were found again."""
        kept = self.text[:start].rstrip()
        safe = max(0, bisect_right(self.starts, len(kept) - self.AHEAD) - 1)
        begin = self.starts[safe] if self.starts else 0
        old, moved = self.starts, len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        starts, pieces, join = [], [], len(old)
        for m in self.e.pattern.finditer(self.text, begin):
            if m.start() >= start + len(new):
                at = bisect_left(old, m.start() - moved)
                if at < len(old) and old[at] == m.start() - moved and old[at] >= stop:
                    join = at
                    break
            starts.append(m.start())
            pieces.append(self.e.pieces[m.group()])
        self.starts = old[:safe] + starts + [x + moved for x in old[join:]]
        self.pieces = self.pieces[:safe] + pieces + self.pieces[join:]
        return len(pieces)

    def ids(self) -> list[int]:
        return [i for ids in self.pieces for i in ids]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, so that its known pieces serve all tasks there."""
    with open(path, "rb") as f:
        return Encoder(f.read().splitlines(), pattern)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    yield from T.slices(batches, column)
    T.forget_later(encoder.cache_clear)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, column: int, decode: bool) -> Iterator[pa.RecordBatch]:
    T.in_use(encoder.cache_clear)
    e = encoder(path, pattern)
    for b in _slices(batches, column):
        ids: list[np.ndarray] = []
        back: list[bytes] = []
        for x in b.column(column):
            got = e.encode(x.as_py() or "")
            ids.append(np.array(got, np.int32))
            if decode:
                back.append(e.decode(got))
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        yield pa.RecordBatch.from_arrays([*b.columns, lists, *([pa.array(back, pa.binary())] if decode else [])], names=[*b.schema.names, "token_ids", *(["decoded"] if decode else [])])


def encode_documents(docs: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """docs with token_ids array<int> (null text: empty), and with decode the decoded bytes.

    Extra columns stay; a column of docs named like a new one is replaced. Empty tables and texts give empty results; rows
    that repeat are encoded alike. path is a rank file that every executor can read.
    """
    docs = docs.drop("token_ids", *(["decoded"] if decode else []))
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", token_ids array<int>" + ", decoded binary" * decode
    return docs.mapInArrow(lambda it: _encoded(it, path, pattern, at, decode), schema)


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    T.in_use(encoder.cache_clear)
    e = encoder(path, pattern)
    for b in _slices(batches, 1):
        n, ids_hex, decoded_hex = [], [], []
        for x in b.column(1):
            ids = e.encode(x.as_py() or "")
            n.append(len(ids))
            ids_hex.append(hashlib.sha256(e.text_of(ids).encode()).hexdigest())
            decoded_hex.append(hashlib.sha256(e.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encoding_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row, without handing the ids themselves to Spark.

    Null texts count as empty: no ids, and the digests of no bytes. Rows that repeat are encoded alike, an empty table gives
    an empty result, and further columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _digests(it, path, pattern), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
