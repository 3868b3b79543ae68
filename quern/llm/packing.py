"""Packing of token sequences by cutting-stock column generation.

1. Documents are encoded once and cut into pieces of the sequence size; what is left of each is a shorter piece. Pieces are
   numbered within their length, inside tasks and over them. Their ids are written with them.
2. The histogram of lengths (as many numbers as a sequence has tokens) is a cutting-stock problem: a linear program over
   patterns of lengths, whose columns come from a knapsack dynamic program over the lengths' prices. A pattern costs the
   tokens of its sequence with padding; one whose sum is a power of two needs none.
3. Amounts of patterns without padding are rounded to whole numbers that the counts allow, and each pattern takes the next
   documents of its lengths by their numbers.
4. What no rounded pattern takes is laid end to end and cut at every sequence end, the last part at powers of two.

The word cache follows the pretokenizer of byte-level BPE: a space before a character that is no white space always begins a
piece, and a single line break between two such characters is one. Words of letters are merged many at a time; all else is
encoded by the tokenizers library as it is.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import text as T
from quern.session import materialise, setting, temporary_tables

SIZE, END_ID, CACHE_UNITS, MERGED_BYTES, RANGE_ROWS = 1024, 0, 800_000, 48, 1 << 18
GAP, MOST_PIVOTS, COLUMNS, STEADY, STALLED = 1e-4, 4096, 64, 0.5, 8

_UNITS = re.compile(r"(?<=\S)(?=\n\S)| (?=\S)").split
# White space other than the space and line break, and pairs of white space.
_ODD = (*"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", "  ", " \n", "\n ", "\n\n")
_WORD = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*)\]}\"\-+=~^_/@>]*)").fullmatch


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary of a byte-level tokenizer."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """The merges of a byte-level BPE over many words at once: in each step every word makes its merge of least rank."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.of_byte = np.array([vocabulary[c] for c in byte_characters()], np.int64)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.uint64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.bits, self.steps = 2 * int(len(merges)).bit_length() // 2 + 3, 0
        slots = 1 << self.bits
        self.keys, self.ranks, self.made = np.full(slots, (1 << 64) - 1, np.uint64), np.full(slots, len(merges), np.int32), np.zeros(slots, np.int32)
        left, place = np.arange(len(keys)), self._slot(keys)
        while len(left):  # open addressing: of those that meet in a free slot one stays, the rest go on to the next slot
            free = self.keys[place] == (1 << 64) - 1
            first = np.unique(np.where(free, place, -1), return_index=True)
            at = first[1][first[0] >= 0]
            self.keys[place[at]], self.ranks[place[at]], self.made[place[at]] = keys[left[at]], left[at], made[left[at]]
            rest = np.ones(len(left), bool)
            rest[at] = False
            left, place = left[rest], (place[rest] + 1) & (slots - 1)
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, slot) of pairs of ids; unknown pairs have the last rank."""
        place, out = self._slot(keys), np.zeros(len(keys), np.int64)
        at = np.arange(len(keys))
        none = np.uint64((1 << 64) - 1)
        found = np.full(len(keys), -1)
        for _ in range(self.steps):
            held = self.keys[place]
            hit = held == keys
            found[at[hit]] = place[hit]
            go = ~hit & (held != none)
            at, keys, place = at[go], keys[go], (place[go] + 1) & (len(self.keys) - 1)
            if not len(at):
                break
        known = found >= 0
        out[:] = np.iinfo(np.int32).max
        out[known] = self.ranks[found[known]]
        return out, found

    def encode(self, words: list[bytes], chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, and each word's number of ids."""
        parts = [self._encode(words[a : a + chunk]) for a in range(0, len(words), chunk)]
        return np.concatenate([p[0] for p in parts]).astype(np.uint32), np.concatenate([p[1] for p in parts])

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        none = np.int64(np.iinfo(np.int32).max)
        n = np.array([len(w) for w in words], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        at, done = np.arange(len(words)), []
        rank, slot = np.full(len(ids), none), np.full(len(ids), -1)

        def look(left: np.ndarray) -> None:
            """The merge of each of these ids with the next one."""
            rank[left], slot[left] = self.find(ids[left].astype(np.uint64) << np.uint64(32) | ids[left + 1].astype(np.uint64))

        last = np.zeros(len(ids), bool)
        last[np.cumsum(n) - 1] = True
        look(np.flatnonzero(~last))
        while len(at):
            stop = np.cumsum(n)
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), stop - n)
            go = best >> 32 < none
            if go.sum() * 2 < len(at):  # words that are done go out once they are the most
                out = np.repeat(~go, n)
                done.append((at[~go], n[~go], ids[out]))
                at, n, ids, rank, slot, best = at[go], n[go], ids[~out], rank[~out], slot[~out], None
                if not len(at):
                    break
                stop = np.cumsum(n)
                best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), stop - n)
                go = np.ones(len(at), bool)
            p = best[go] & np.int64((1 << 32) - 1)
            ids[p] = self.made[slot[p]]
            keep = np.ones(len(ids), bool)
            keep[p + 1] = False
            begin, end = (stop - n)[go], stop[go]
            ids, rank, slot = ids[keep], rank[keep], slot[keep]
            gone = np.arange(len(p))
            more, before = p + 2 < end, p > begin
            n[go] -= 1
            p = p - gone
            rank[p], slot[p] = none, -1
            look(np.concatenate([p[more], p[before] - 1]))
        order = np.concatenate([d[0] for d in done])
        size, flat = np.concatenate([d[1] for d in done]), np.concatenate([d[2] for d in done])
        begin = np.empty(len(words), np.int64)
        begin[order], n = np.cumsum(size) - size, np.empty(len(words), np.int64)
        n[order] = size
        stop = np.cumsum(n)
        return flat[np.repeat(begin - (stop - n), n) + np.arange(stop[-1])], n


def units_of(text: str) -> list[str]:
    """A text cut before each space or line break that stands alone; a unit lacks its space, but not its line break."""
    if text[-1] in " \n" or any(c in text for c in _ODD):
        return _UNITS(text)
    return text.replace("\n", " \n").split(" ")


class UnitCache(dict):
    """Units of texts (words with what follows them up to the next cut) to numbers, whose ids lie in flat arrays.

    A unit begins with a line break or else stands behind a space. The first CACHE_UNITS are kept, others for their block alone.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        d = json.loads(self.tokenizer.to_str())
        split, model = d["pre_tokenizer"] or {}, d["model"]
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        self.by_units = model["type"] == "BPE" and not any(model.get(o) for o in options) and d["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space")
        self.by_units = self.by_units and all("<|" in t["content"] for t in d["added_tokens"])
        if self.by_units:
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.merges = Merges(model["vocab"], pairs)
            self.break_ids = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.end_id = end_id
        self.once: dict[str, int] = {}  # this block's units beyond those kept
        self.kept: tuple[int, int] | None = None  # lengths of the arrays when the cache was full
        self.new: list[str] = []
        self.flat, self.start, self.length = np.array([end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def __missing__(self, unit: str) -> int:
        if self.kept and (k := self.once.get(unit)) is not None:
            return k
        self.new.append(unit)
        (self.once if self.kept else self)[unit] = k = len(self.start) + len(self.new) - 1
        return k

    def _put(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Starts of new ids in flat."""
        start = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate([self.flat, flat])
        return start

    def _learn(self) -> None:
        """Words of letters with marks are made of both parts, of which many are merged at once; other units go to the library."""
        parts: dict[bytes, int] = {}
        two, others = np.zeros((len(self.new), 2), np.int64), []
        for i, unit in enumerate(self.new):
            if (m := _WORD(unit)) and len(word := (("" if m[1] else " ") + m[2]).encode()) <= MERGED_BYTES and len(m[3]) < MERGED_BYTES:
                two[i] = parts.setdefault(word, len(parts)), parts.setdefault(m[3].encode(), len(parts)) if m[3] else -1
            else:
                others.append(i)
                two[i] = -2
        words = list(parts)
        start, n = np.zeros(len(self.new), np.int64), np.zeros(len(self.new), np.int64)
        if words:
            flat, size = self.merges.encode(words)
            at = np.concatenate([np.cumsum(size) - size, [0]])
            size = np.append(size, 0)
            simple = np.flatnonzero(two[:, 0] >= 0)
            broken = np.array([self.new[i][0] == "\n" for i in simple], bool)
            flat = np.concatenate([flat, np.array(self.break_ids, np.uint32)])
            pieces = np.stack([np.full(len(simple), len(flat) - len(self.break_ids)), at[two[simple, 0]], at[two[simple, 1]]], 1)
            sizes = np.stack([np.where(broken, len(self.break_ids), 0), size[two[simple, 0]], size[two[simple, 1]]], 1)
            whole, count = sizes.ravel(), sizes.sum(1)
            stop = np.cumsum(whole)
            start[simple] = self._put(flat[np.repeat(pieces.ravel() - (stop - whole), whole) + np.arange(stop[-1])], count)
            n[simple] = count
        if others:
            got = [e.ids for e in self.tokenizer.encode_batch_fast([self.new[i] if self.new[i][:1] == "\n" else " " + self.new[i] for i in others], add_special_tokens=False)]
            count = np.array([len(g) for g in got], np.int64)
            start[others] = self._put(np.fromiter(chain.from_iterable(got), np.uint32, count.sum()), count)
            n[others] = count
        self.start, self.length, self.new = np.concatenate([self.start, start]), np.concatenate([self.length, n]), []

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and each text's number of ids."""
        plain = [self.by_units and "<|" not in x and x[:1].strip() != "" for x in texts]
        units = [units_of(x) if p else () for x, p in zip(texts, plain)]
        counts = np.array([len(u) + 1 for u in units], np.int64)
        last = np.cumsum(counts) - 1
        at = np.zeros(counts.sum(), np.int64)
        inner = np.ones(len(at), bool)
        inner[last] = False
        heads = [i for i, p in enumerate(plain) if p]
        for i in heads:  # a text's first word has no space before it: it is looked up behind a line break
            units[i][0] = "\n" + units[i][0]
        at[inner] = np.fromiter(map(self.__getitem__, chain.from_iterable(units)), np.int64, len(at) - len(texts))
        if self.new:
            self._learn()
        start, n = self.start[at], self.length[at]
        begin = last - counts + 1
        skip = len(self.break_ids) if self.by_units else 0
        start[begin[heads]] += skip
        n[begin[heads]] -= skip
        flat = self.flat
        whole = [i for i, p in enumerate(plain) if not p and texts[i]]
        if whole:
            got = [self.tokenizer.encode(texts[i], add_special_tokens=False).ids + [self.end_id] for i in whole]
            size = np.array([len(g) for g in got], np.int64)
            start[begin[whole]], n[begin[whole]] = len(flat) + np.cumsum(size) - size, size
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(got), np.uint32, size.sum())])
        stop = np.cumsum(n)
        out = flat[np.repeat(start - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        if self.kept:
            self.once.clear()
            self.start, self.length, self.flat = self.start[: self.kept[0]], self.length[: self.kept[0]], self.flat[: self.kept[1]]
        elif len(self) > CACHE_UNITS:
            self.kept = len(self.start), len(self.flat)
        return out, np.add.reduceat(n, begin) if len(texts) else counts


@lru_cache(maxsize=1)
def unit_cache(path: str, end_id: int) -> UnitCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitCache(path, end_id)


_PIECE_DDL = "part int, doc_id long, start long, length int, number long, ids_crc32 long, doc_tokens long, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, cache = TaskContext.get().partitionId(), unit_cache(path, end_id)
    seen = np.zeros(size + 1, np.int64)
    for b in T.slices(batches, 1):
        values, n = cache.ids([x or "" for x in b.column(1).to_pylist()])
        count = -(-n // size)
        doc = np.repeat(np.arange(len(n)), count)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = within * size
        length = np.minimum(size, n[doc] - start)
        stop = np.cumsum(length)
        order = np.argsort(length, kind="stable")
        number = np.empty(len(doc), np.int64)
        number[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
        number += seen[length]
        seen += np.bincount(length, minlength=size + 1)
        raw = values.astype("<u4").tobytes()
        view = memoryview(raw)
        crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(stop - length, stop)]
        offsets = np.concatenate([[0], 4 * stop]).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), part, np.int32)), b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(number), pa.array(crc, pa.int64()), pa.array(n[doc]), ids], names=["part", "doc_id", "start", "length", "number", "ids_crc32", "doc_tokens", "ids"])


def padded(total: int, size: int) -> int:
    """Tokens of a sequence with padding."""
    return total if total & (total - 1) == 0 else size


class Program:
    """The linear program min cost x amounts over patterns of lengths that meet the counts, by revised simplex.

    A column is a pattern (numbers of lengths, copies, cost). The basis begins with patterns that take the longest length
    left and fill the sequence exactly where they can, each up to the amount that uses one length up.
    """

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, size: int):
        self.lengths, self.size = lengths, size
        self.cost = np.array([0, *(padded(t, size) for t in range(1, size + 1))], np.float64)
        self.basis: list[tuple[np.ndarray, np.ndarray, float]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0)] * len(counts)
        self.inverse, self.amounts = np.eye(len(counts)), np.zeros(len(counts))
        self._begin(counts)
        self.prices = (np.array([b[2] for b in self.basis])[:, None] * self.inverse).sum(0)

    def _begin(self, counts: np.ndarray) -> None:
        left, open_ = counts.astype(np.float64), np.ones(len(counts), bool)
        for i in reversed(range(len(self.lengths))):
            while open_[i]:
                room = self.size - int(self.lengths[i])
                price = np.full(self.size + 1, -np.inf)
                price[self.lengths[open_]] = self.lengths[open_].astype(np.float64) ** 2
                best, last = self._knapsack(price, room)
                at, copies, cost = self._pattern(last, int(self.lengths[i]) + int(np.flatnonzero(np.isfinite(best))[-1]), int(self.lengths[i]))
                ratio = left[at] / copies
                r = int(ratio.argmin())
                left[at] -= ratio[r] * copies
                open_[at[r]] = False
                self.amounts[at[r]] = ratio[r]
                self._replace(int(at[r]), (at, copies, cost))

    def _knapsack(self, price: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The best price of exactly t tokens for each t up to size, and the last length taken."""
        best, last = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
        best[0] = 0
        backwards = np.full(size + 1, -np.inf)  # best, reversed: best[t - n] for n = 1, 2, ... lies together
        backwards[size] = 0
        for t in range(1, size + 1):
            s = price[1 : t + 1] + backwards[size - t + 1 : size + 1]
            n = int(s.argmax())
            best[t] = backwards[size - t] = s[n]
            last[t] = n + 1
        return best, last

    def _pattern(self, last: np.ndarray, total: int, also: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
        own = [also] if also else []
        t = total - also
        while t:
            own.append(int(last[t]))
            t -= int(last[t])
        n, copies = np.unique(own, return_counts=True)
        return np.searchsorted(self.lengths, n), copies, self.cost[total]

    def _enter(self, column: tuple[np.ndarray, np.ndarray, float], least: float) -> bool:
        at, copies, cost = column
        reduced = cost - float((self.prices[at] * copies).sum())
        if reduced > -least:
            return False
        d = self._direction(at, copies)
        up = np.flatnonzero(d > 1e-7)
        if not len(up):
            return False
        ratio = self.amounts[up] / d[up]
        step = max(0.0, float(ratio.min()))
        ties = up[ratio <= step + 1e-9]
        r = int(ties[d[ties].argmax()])
        self.amounts -= step * d
        self.amounts[r] = step
        self.prices += reduced * self.inverse[r] / d[r]
        self._replace(r, column)
        return True

    def _direction(self, at: np.ndarray, copies: np.ndarray) -> np.ndarray:
        return (self.inverse[:, at] * copies).sum(1)  # few columns; kept from linear algebra threads, as Spark's driver forks

    def _replace(self, r: int, column: tuple[np.ndarray, np.ndarray, float]) -> None:
        """Column r of the basis by another one."""
        d = self._direction(column[0], column[1])
        row = self.inverse[r] / d[r]
        d[r] = 0
        rows, cols = np.flatnonzero(np.abs(d) > 1e-13), np.flatnonzero(np.abs(row) > 1e-13)
        if len(rows) * len(cols) > self.inverse.size // 2:
            self.inverse[rows] -= d[rows, None] * row
        elif len(rows) and len(cols):
            self.inverse[np.ix_(rows, cols)] -= d[rows, None] * row[cols]
        self.inverse[r] = row
        self.basis[r] = column

    def _error(self) -> float:
        """How far the prices are from those of the basis."""
        return max(abs(float((self.prices[at] * copies).sum()) - cost) for at, copies, cost in self.basis)

    def solve(self, counts: np.ndarray, gap: float = GAP, most: int = MOST_PIVOTS) -> None:
        """Take in columns until none is cheaper, or all padding is under gap of the tokens, or STALLED knapsacks save less.

        Without padding a token's price is one. Columns are sought at prices between that and the basis's own, which keeps
        these from swinging; at the basis's own prices if that finds none.
        """
        tokens, pivots, held = float((counts * self.lengths).sum()), 0, []
        steady = STEADY
        while pivots < most:
            held.append(sum(b[2] * x for b, x in zip(self.basis, self.amounts)) / tokens)
            if held[-1] <= 1 + gap or len(held) > STALLED and held[-1 - STALLED] - held[-1] < gap:
                break
            price = np.full(self.size + 1, -np.inf)
            price[self.lengths] = steady * self.lengths + (1 - steady) * self.prices
            best, last = self._knapsack(price, self.size)
            ends = np.flatnonzero(np.isfinite(best[1:]))[-self.size :] + 1
            ends = ends[np.argsort((self.cost - best)[ends])][:COLUMNS]
            rest = self.size - self.lengths
            value = np.where(np.isfinite(best[rest]), best[rest] + price[self.lengths], -np.inf)
            also = [(self.size, int(self.lengths[i])) for i in np.argsort(-value)[: len(value)] if np.isfinite(value[i])]
            entered = 0
            for t, n in [*((int(t), 0) for t in ends), *also]:
                entered += self._enter(self._pattern(last, t, n), 1e-9 * self.size)
                if entered >= COLUMNS:
                    break
            if not entered and not steady:
                break
            steady = STEADY if entered else 0.0
            pivots += entered
            if self._error() > 1e-6 * self.size:
                break  # amounts are still right, but prices no longer


def rounded(lengths: np.ndarray, counts: np.ndarray, size: int) -> tuple[list[tuple[np.ndarray, np.ndarray, int]], np.ndarray]:
    """Whole amounts of patterns without padding, (numbers of lengths, copies, amount), and the counts that they leave."""
    p = Program(lengths, counts.astype(np.float64), size)
    p.solve(counts.astype(np.float64))
    left, out = counts.copy(), []
    order = np.argsort(-(p.amounts - np.floor(p.amounts + 1e-6)), kind="stable")
    tight = [int(j) for j in order if (t := int(p.lengths[p.basis[j][0]] @ p.basis[j][1])) == padded(t, size)]
    amounts = dict.fromkeys(tight, 0)
    for up in (False, True):
        for j in tight:
            at, copies, _ = p.basis[j]
            fit = int((left[at] // copies).min())
            n = min(fit, max(0, int(np.floor(p.amounts[j] + 1e-6))) if not up else 1)
            amounts[j] += n
            left[at] -= n * copies
    for j in tight:  # what is left may still hold some of them
        at, copies, _ = p.basis[j]
        n = int((left[at] // copies).min())
        amounts[j] += n
        left[at] -= n * copies
        if amounts[j]:
            out.append((at, copies, amounts[j]))
    return out, left


def plan(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int, int]], int, dict[int, int]]:
    """(length, first, stop, copies, base, offset) of each stretch of a length's pieces, by number, that one pattern takes.

    Piece g of them is in sequence base + (g - first) div copies at offset + (g - first) mod copies * length. Pieces from
    the last stop on are left. Also: the number of sequences, and for each length the number of pieces placed.
    """
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    if not len(lengths):
        return [], 0, {}
    counts = np.array([histogram[n] for n in lengths], np.int64)
    taken, out, base = dict.fromkeys(lengths.tolist(), 0), [], 0
    for at, copies, amount in rounded(lengths, counts, size)[0]:
        offset = 0
        for i, c in zip(at, copies):
            n = int(lengths[i])
            out.append((n, taken[n], taken[n] + int(c) * amount, int(c), base, offset))
            taken[n] += int(c) * amount
            offset += int(c) * n
        base += amount
    return out, base, taken


_KEY = ["part", "length", "number"]


def _laid_end_to_end(rest: DataFrame, tokens: int, n: int, first: int, size: int) -> DataFrame:
    """rest with (from, to, sequence_id, offset) of each part of a piece, as if all were one sequence, cut; from first on."""
    order = ["doc_id", "start", "part", "number"]
    dealt = rest.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *order).withColumn("__part", F.spark_partition_id())
    dealt = materialise(dealt, "rest")
    totals = dealt.groupBy("__part").agg(F.sum("length").alias("own"))
    before = totals.select("__part", (F.sum("own").over(Window.orderBy("__part")) - F.col("own")).alias("before"))  # a row a range
    inner = F.sum("length").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("__in", inner).join(F.broadcast(before), "__part").withColumn("b", F.col("before") + F.col("__in")).withColumn("a", F.col("b") - F.col("length"))
    main = tokens - tokens % size
    ends, at = [], main
    for bit in reversed(range(size.bit_length())):  # the last part has a sequence for each of its binary digits
        if tokens % size >> bit & 1:
            ends.append((at, at + (1 << bit)))
            at += 1 << bit
    cuts = F.array("a", "b", F.expr(f"(a div {size} + 1) * {size}"), *(F.lit(x[0]).cast("long") for x in ends))
    cuts = F.array_sort(F.array_distinct(F.filter(cuts, lambda c: (c >= F.col("a")) & (c <= F.col("b")))))
    inside = placed.withColumn("cuts", cuts).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)))
    inside = inside.withColumn("x", F.get("cuts", F.col("k"))).withColumn("y", F.get("cuts", F.col("k") + 1))
    sequence, offset = F.expr(f"x div {size}"), F.expr(f"x % {size}")
    for k, (lo, hi) in enumerate(ends):
        here = (F.col("x") >= lo) & (F.col("x") < hi)
        sequence, offset = F.when(here, F.lit(main // size + k)).otherwise(sequence), F.when(here, F.col("x") - lo).otherwise(offset)
    return inside.select(*rest.columns, (F.col("x") - F.col("a")).alias("from"), (F.col("y") - F.col("a")).alias("to"), (sequence + first).alias("sequence_id"), offset.alias("offset"))


_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """Pack docs (doc_id, text, ...) into sequences of size tokens; returns the pieces and the table that holds their ids.

    Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, key): start counts the ids of the document
    before the piece, offset those of the sequence, and ids_crc32 is that of the ids as little-endian 32-bit integers. Every
    sequence holds size ids or a power of two, so nothing is padded. key names the piece in the table of ids, for sequences.

    A document's ids are those of the tokenizers library without special tokens, and end_id. Null and empty texts have the
    end id alone, rows that repeat are documents of their own, a null doc_id stays null, and an empty table gives no pieces.
    Further columns are not read. tokenizer is a file that every executor can read; size is a power of two.
    """
    if size < 2 or size & (size - 1):
        raise ValueError("the size of a sequence must be a power of two")
    spark = docs.sparkSession
    with temporary_tables(spark) as keep, setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2048"):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _pieces(it, tokenizer, end_id, size), _PIECE_DDL)
        pieces = keep(materialise(rows, "pieces"))
        parts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "parts")
        histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # size numbers
        stretches, n_sequences, taken = plan(histogram, size)
        everything = [*stretches, *((n, taken[n], 1 << 62, 0, 0, 0) for n in taken)]
        table = F.broadcast(spark.createDataFrame(everything, "p_length int, first long, stop long, copies long, base long, p_offset int"))  # 1,024 patterns of 45 lengths at most
        before = parts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
        numbered = pieces.drop("ids").join(before, ["part", "length"]).withColumn("g", F.col("before") + F.col("number"))
        numbered = numbered.join(table, (F.col("length") == F.col("p_length")) & (F.col("g") >= F.col("first")) & (F.col("g") < F.col("stop")))
        numbered = materialise(numbered.drop("p_length", "stop", "before"), "numbered")
        key = F.struct(*_KEY).alias("key")
        within = F.expr("(g - first) % copies")
        placed = numbered.where("copies > 0").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.expr("(g - first) div copies")).alias("sequence_id"), (F.col("p_offset") + within * F.col("length")).cast("long").alias("offset"), key)
        left = {n: c - taken[n] for n, c in histogram.items() if c > taken[n]}
        rest = numbered.where("copies = 0").select("doc_id", "start", "doc_tokens", "ids_crc32", *_KEY)
        if left:
            laid = materialise(_laid_end_to_end(rest, sum(n * c for n, c in left.items()), sum(left.values()), n_sequences, size), "laid")
            whole = F.col("to") - F.col("from") == F.col("length")
            shape = lambda crc: (F.col("doc_id"), (F.col("start") + F.col("from")).alias("start"), (F.col("to") - F.col("from")).cast("int").alias("length"), crc.alias("ids_crc32"), F.col("doc_tokens"), F.col("sequence_id"), F.col("offset").cast("long").alias("offset"), key)
            cut = laid.where(~whole).drop("ids_crc32").join(pieces.select(*_KEY, "ids"), _KEY)
            part = F.expr("substring(ids, cast(4 * `from` + 1 AS int), cast(4 * (`to` - `from`) AS int))")
            placed = placed.unionByName(laid.where(whole).select(*shape(F.col("ids_crc32")))).unionByName(cut.select(*shape(F.crc32(part))))
        return keep(materialise(placed.withColumn("length", F.col("length").cast("long")), "packed")), pieces


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) with the ids of every sequence, as little-endian 32-bit integers."""
    held = pieces.select(F.struct(*_KEY).alias("key"), F.col("start").alias("piece_start"), "ids")
    j = packed.join(held, "key")
    part = F.expr("substring(ids, cast(4 * (start - piece_start) + 1 AS int), cast(4 * length AS int))")
    listed = F.sort_array(F.collect_list(F.struct("offset", part.alias("ids"))))
    return j.groupBy("sequence_id").agg(listed.alias("l")).select("sequence_id", F.expr("aggregate(l, cast('' AS binary), (a, x) -> concat(a, x.ids))").alias("ids"))
