"""Token-id files in directly addressable codes (Brisaboa, Ladra and Navarro, 2013).

Each id is cut into 8-bit chunks. Level k holds chunk k of all ids that have one, a bitmap of which ids go on, and a rank
directory (ones before every 512 bits), so token i is read by one step a level, without decoding any block.

A segment is one binary value: a header, the level data, and its documents' ids and ends. A file set is a table of segments
in the shared folder, ascending by document, with a small table of each segment's first token.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import text as T
from quern.session import materialise, ranges

if TYPE_CHECKING:
    from tokenizers import Tokenizer

MARKS = b".,;:!?|#$%&*)]}\"-+=~^_/@<>"
MAGIC, END_ID, SEGMENT_TOKENS, CACHE_WORDS, RANK_BITS = b"DAC1", 1, 1 << 21, 1_000_000, 512


def encode_codes(values: np.ndarray) -> bytes:
    """Levels of 8-bit chunks of unsigned 32-bit values: count, then for each level chunks, bitmap and rank directory."""
    rest, out = values.astype(np.uint32), [struct.pack("<Q", len(values))]
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype(np.uint32)
        out += [struct.pack("<QQQ", len(rest), len(bits), len(ranks)), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        rest = rest[more] >> 8
        if not len(rest):
            return b"".join([struct.pack("<I", (len(out) - 1) // 4), *out])


class Codes:
    """Random and sequential access to encoded values."""

    def __init__(self, data: bytes | memoryview):
        levels, self.n = struct.unpack_from("<IQ", data)
        at, self.levels = 12, []
        for _ in range(levels):
            n, n_bits, n_ranks = struct.unpack_from("<QQQ", data, at)
            at += 24
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(data, np.uint8, 4 * n_ranks, at + n + n_bits).view(np.uint32) if (at + n + n_bits) % 4 == 0 else np.frombuffer(bytes(data[at + n + n_bits : at + n + n_bits + 4 * n_ranks]), np.uint32)
            at += n + n_bits + 4 * n_ranks
            self.levels.append((chunks, bits, ranks))
        self.size = at

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BITS
            head = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(ranks[block]) + int(head.sum())
        return value

    def take(self, places: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Values at places, each by one step a level as in [], a chunk of places at a time."""
        out = np.zeros(len(places), np.uint32)
        for a in range(0, len(places), chunk):
            i, at = np.asarray(places[a : a + chunk], np.int64), np.arange(a, min(a + chunk, len(places)))
            for k, (chunks, bits, ranks) in enumerate(self.levels):
                out[at] |= chunks[i].astype(np.uint32) << np.uint32(8 * k)
                more = bits[i >> 3] >> (i & 7).astype(np.uint8) & 1 == 1
                i, at = i[more], at[more]
                if not len(i):
                    break
                block = i // RANK_BITS
                near = np.minimum(block[:, None] * (RANK_BITS // 8) + np.arange(RANK_BITS // 8), len(bits) - 1)
                before = np.unpackbits(bits[near], axis=1, bitorder="little") & (np.arange(RANK_BITS) < (i % RANK_BITS)[:, None])
                i = ranks[block].astype(np.int64) + before.sum(1, dtype=np.int64)
        return out

    def all(self) -> np.ndarray:
        at, out = None, np.zeros(self.n, np.uint32)
        for k, (chunks, bits, _) in enumerate(self.levels):
            more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            part = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out, at = part, np.flatnonzero(more)
            else:
                out[at] |= part
                at = at[more]
        return out


def write_segment(values: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], np.int64)
    return b"".join([MAGIC, struct.pack("<Q", len(ids)), ids.tobytes(), np.cumsum(lengths, dtype=np.int64).tobytes(), known.tobytes(), encode_codes(values)])


class Segment:
    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        (n,) = struct.unpack_from("<Q", data, 4)
        self.doc_ids, self.ends = np.frombuffer(data, np.int64, n, 12), np.frombuffer(data, np.int64, n, 12 + 8 * n)
        self.known = np.frombuffer(data, np.uint8, n, 12 + 16 * n)
        self.codes = Codes(memoryview(data)[12 + 17 * n :])

    def document(self, i: int) -> np.ndarray:
        """Ids of one document by random access."""
        return self.codes.take(np.arange(int(self.ends[i - 1]) if i else 0, int(self.ends[i])))


def _stays_letters(word: str) -> bool:
    """Whether a word of letters is one of letters once it is normalised and lower-cased as well."""
    return word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha()


def drops_space(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer works on words apart: pieces end in </w>, and its own splitting leaves no white space in any piece.

    Its settings must be ones for which that holds at every place: normalizers that keep white space apart, a first splitter
    that removes all but matches, whose pattern can match no white space (in ASCII, where texts are taken apart), and added
    tokens without white space.
    """
    d = json.loads(tokenizer.to_str())
    parts = lambda x, many: [x] if x and many not in x else (x or {}).get(many, [])
    kinds = [n["type"] for n in parts(d["normalizer"], "normalizers")]
    replaced = [(n["pattern"], n["content"]) for n in parts(d["normalizer"], "normalizers") if n["type"] == "Replace"]
    split = (parts(d["pre_tokenizer"], "pretokenizers") or [{}])[0]
    pattern = split.get("pattern", {}).get("Regex", "\\s")
    return (
        d["model"]["type"] == "BPE"
        and d["model"].get("end_of_word_suffix") == "</w>"
        and set(kinds) <= {"NFC", "Lowercase", "Replace"}
        and all(r == ({"Regex": "\\s+"}, " ") for r in replaced)
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and not regex.search(pattern, " \t\n\v\f\r")
        and all("<|" in t["content"] and not regex.search("\\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in d["added_tokens"])
    )


class WordCache(dict):
    """Words (as bytes) to numbers, whose ids lie in flat arrays; unseen words are encoded a block at a time.

    The first CACHE_WORDS words are kept; after that, unseen ones are held for their block alone.

    The tokenizer must drop white space and never join across it (drops_space), so that a text's ids are those of its words
    in turn; texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.once: dict[bytes, int] = {}  # words of this block beyond those kept
        self.kept: tuple[int, int] | None = None  # lengths of the arrays when the cache was full
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.by_words = drops_space(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_piece = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_piece[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.new: list[bytes | tuple[int, int]] = []  # unseen words, or the numbers of the two parts of one
        self.flat, self.start, self.length = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        if self.kept and (k := self.once.get(word)) is not None:
            return k
        letters = word.rstrip(MARKS)
        if letters and letters != word and letters[-1:].isalpha() and b"<|" not in word:
            self.new.append((self[letters], self[word[len(letters) :]]))
        else:
            self.new.append(word)
        k = len(self.start) + len(self.new) - 1
        (self.once if self.kept else self)[word] = k
        return k

    def _learn(self) -> None:
        """Ids of the new words; those that end in marks are made of the letters before and the marks, which part there."""
        plain = [w.decode() for w in self.new if type(w) is bytes]
        simple = np.array([w.isalpha() and _stays_letters(w) for w in plain], bool)
        first, n_new = len(self.start), len(self.new)
        own = np.array([type(w) is bytes for w in self.new], bool)
        start, length = np.zeros(n_new, np.int64), np.zeros(n_new, np.int64)
        for which, encode in ((simple, self._encode_joined), (~simple, self._encode_each)):
            flat, n = encode([w for w, x in zip(plain, which) if x])
            at = np.flatnonzero(own)[which]
            start[at], length[at] = len(self.flat) + np.cumsum(n) - n, n
            self.flat = np.concatenate([self.flat, flat])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        if not own.all():
            parts = np.array([w for w in self.new if type(w) is not bytes], np.int64).ravel()
            n = self.length[parts]
            stop = np.cumsum(n)
            joined = self.flat[np.repeat(self.start[parts] - (stop - n), n) + np.arange(stop[-1])]
            at = first + np.flatnonzero(~own)
            self.length[at] = n[::2] + n[1::2]
            self.start[at] = len(self.flat) + (stop - n)[::2]
            self.flat = np.concatenate([self.flat, joined])
        self.new = []

    def _encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, n.sum()), n

    def _encode_joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters alone, as one text: each is one piece, and ends with its first token that can end a piece."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        flat = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        n = np.diff(np.flatnonzero(self.ends_piece[flat]), prepend=-1)
        return (flat, n) if len(n) == len(words) and n.sum() == len(flat) else self._encode_each(words)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and each text's number of ids."""
        if not self.by_words:
            got = [self.tokenizer.encode(x.decode(), add_special_tokens=False).ids + [self.end_id] for x in texts]
            return np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got))), np.array([len(x) for x in got], np.int64)
        words = [x.split() for x in texts]
        counts = np.array([len(w) + 1 for w in words], np.int64)
        at = np.zeros(counts.sum(), np.int64)
        inner = np.ones(len(at), bool)
        inner[np.cumsum(counts) - 1] = False
        at[inner] = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, len(at) - len(texts))
        if self.new:
            self._learn()
        n = self.length[at]
        stop = np.cumsum(n)
        out = self.flat[np.repeat(self.start[at] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        if self.kept:
            self.once.clear()
            self.start, self.length, self.flat = self.start[: self.kept[0]], self.length[: self.kept[0]], self.flat[: self.kept[1]]
        elif len(self) > CACHE_WORDS:
            self.kept = len(self.start), len(self.flat)
        return out, np.add.reduceat(n, np.cumsum(counts) - counts) if len(counts) else counts


@lru_cache(maxsize=2)
def word_cache(path: str, end_id: int) -> WordCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCache(path, end_id)


_SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    T.in_use(word_cache.cache_clear)
    part, cache = TaskContext.get().partitionId(), word_cache(path, end_id)
    held: list[np.ndarray] = []
    lengths: list[np.ndarray] = []
    docs: list[int | None] = []
    seq = size = 0

    def flush() -> pa.RecordBatch:
        data = write_segment(np.concatenate(held), docs, np.concatenate(lengths))
        return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(docs)], "n_tokens": [size], "data": [data]}, schema=_SEGMENT)

    for b in T.slices(batches, 1):
        ids = b.column(0).to_pylist()
        for i, j, data, off in T.blocks(b.column(1)):
            raw = data.tobytes()
            values, n = cache.ids([raw[off[k] : off[k + 1]] for k in range(j - i)])
            held.append(values)
            lengths.append(n)
            docs += ids[i:j]
            size += len(values)
            if size >= SEGMENT_TOKENS:
                yield flush()
                held, lengths, docs, size, seq = [], [], [], 0, seq + 1
    if docs:
        yield flush()
    T.forget_later(word_cache.cache_clear)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """Encode docs (doc_id, text, ...) into segments ascending by doc_id (null first, ties by text).

    Returns the written segments (part, seq, n_docs, n_tokens, data) and their index (part, seq, base): base is the number
    of ids before the segment. Null and empty texts have the end id alone; an empty table gives no segment. tokenizer is a
    file of the tokenizers library that every executor can read. doc_id is an integer column.
    """
    spark = docs.sparkSession
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(ranges(docs), "doc_id", F.xxhash64("text"))
    made = dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).mapInArrow(lambda it: _segments(it, tokenizer, end_id), "part int, seq int, n_docs long, n_tokens long, data binary")
    segments = materialise(made, "segments", "snappy")  # codes hardly shrink further
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    index = segments.select("part", "seq", inner.alias("within"), "n_tokens").join(totals, "part").select("part", "seq", (F.col("before") + F.col("within")).alias("base"))
    return segments, materialise(index, "index")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, seq, data in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "data"))):
            s = Segment(data)
            values = s.codes.all().astype("<u4")
            starts = np.concatenate([[0], s.ends[:-1]])
            crc = [zlib.crc32(values[i:j]) for i, j in zip(starts, s.ends)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(s.doc_ids, mask=s.known == 0), pa.array(starts), pa.array(s.ends - starts), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"])


def read_documents(segments: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the segments.

    Documents without text have the end id alone; rows that repeat or have a null doc_id are listed each; without segments
    the result is empty.
    """
    rows = segments.select("part", "seq", "data").mapInArrow(_documents, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(index, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _taken(key: tuple, segment: pa.Table, places: pa.Table) -> pa.Table:
    """Values at some places of one segment."""
    if not segment.num_rows or not places.num_rows:
        return pa.table({"position": pa.array([], pa.int64()), "token_id": pa.array([], pa.int64())})
    within = places.column("within").to_numpy()
    values = Segment(segment.column("data")[0].as_py()).codes.take(within)
    return pa.table({"position": places.column("position").to_numpy(), "token_id": values.astype(np.int64)})


def read_tokens(segments: DataFrame, index: DataFrame, positions: DataFrame) -> DataFrame:
    """positions (position, ...) with token_id, the id at that place of all files' ids, read without decoding a block.

    Each position finds its segment by the stretches of SEGMENT_TOKENS that segments meet, and each segment is opened once
    for all positions in it. A position that is null or out of range has a null token_id; positions may repeat, and other
    columns stay (one named token_id is replaced).
    """
    size = segments.select("part", "seq", "n_tokens")
    parts = index.join(size, ["part", "seq"]).withColumn("stretch", F.explode(F.sequence(F.expr(f"base div {SEGMENT_TOKENS}"), F.expr(f"(base + n_tokens - 1) div {SEGMENT_TOKENS}"))))
    wanted = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("stretch", F.expr(f"position div {SEGMENT_TOKENS}"))
    wanted = wanted.join(parts, "stretch").where("position >= base AND position < base + n_tokens").select("part", "seq", "position", (F.col("position") - F.col("base")).alias("within"))
    opened = segments.join(wanted.select("part", "seq").distinct(), ["part", "seq"], "left_semi").select("part", "seq", "data")
    got = opened.groupBy("part", "seq").cogroup(wanted.groupBy("part", "seq")).applyInArrow(_taken, "position long, token_id long")
    return positions.drop("token_id").join(got.withColumnRenamed("position", "__position"), F.col("position") == F.col("__position"), "left").drop("__position")
