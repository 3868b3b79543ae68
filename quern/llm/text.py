"""Vectorised text primitives: words and shingles of whole Arrow string batches, hashed in numpy.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
All arrays of one block cover a few megabytes of text, whatever the size of the Arrow batch, so memory stays
bounded by the block (or by one document, where that is longer).
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES, IDLE_SECONDS = 1 << 21, 4.0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POSITION = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = _rng.integers(1, 1 << 63, 64, dtype=np.uint64)

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    out = []
    for b in (_BASE, _INV):
        x = np.full(n, b, dtype=np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


_kept_powers = lru_cache(maxsize=1)(lambda: _make_powers(BLOCK_BYTES))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers; those of a longer text than a block are not kept, so that idle workers stay small."""
    return _kept_powers() if n <= BLOCK_BYTES else _make_powers(n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], at: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with at most so many bytes in column at (one row, where that is longer).

    After the last one, freed memory goes back to the system, so an idle worker holds little.
    """
    try:
        for b in batches:
            for i, j, _, _ in blocks(b.column(at), most):
                yield b.slice(i, j - i)
    finally:
        release()


def release() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_timers: dict[Callable[[], None], threading.Timer] = {}


def in_use(clear: Callable[[], None]) -> None:
    """A cache that was to be cleared later is wanted again."""
    if (timer := _timers.pop(clear, None)) is not None:
        timer.cancel()


def forget_later(clear: Callable[[], None], seconds: float = IDLE_SECONDS) -> None:
    """Clear a worker's cache once it hasn't been used for some seconds: idle workers count into the memory of other stages."""

    def run() -> None:
        clear()
        release()

    in_use(clear)
    _timers[clear] = threading.Timer(seconds, run)
    _timers[clear].daemon = True
    _timers[clear].start()


class Words:
    """Words of a block of documents: hash, first and past-last byte, and the first word of each document (n + 1)."""

    __slots__ = ("data", "docs", "hash", "start", "end", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, hashed: bool = True, letters: np.ndarray = _WORD):
        self.data, self.docs = data, offsets
        n = len(data)
        w = letters[data]
        head = w.copy()
        head[1:] &= ~w[:-1]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        head[inner] = w[inner]
        tail = w.copy()
        tail[:-1] &= ~w[1:]
        tail[inner - 1] = w[inner - 1]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, offsets)
        if hashed:
            p, q = _powers(n)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((_BYTE[_LOWER] if lower else _BYTE)[data] * p[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * q[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), self.counts())


def blocks(col: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past-last row, bytes, offsets) in blocks of whole documents."""
    data, off = string_buffers(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in text order and each document's first (n + 1).

    A document of 1 to k - 1 words has one shingle, its whole sequence; one without words has none.
    """
    h, first = words.hash, words.first
    n, m = len(h), words.counts()
    full = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        full += h[j : n - k + 1 + j] * _POSITION[j] if len(full) else full
    full = mix(full + _LENGTH[k]) if len(full) else full
    size = np.where(m >= k, m - k + 1, (m > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(begin[-1], dtype=np.uint64)
    long = m >= k
    if long.any():
        at = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(first[:-1], size)
        of_long = np.repeat(long, size)
        out[of_long] = full[at[of_long]]
    for d in np.flatnonzero((m > 0) & ~long):
        s = h[first[d] : first[d + 1]]
        out[begin[d]] = mix(np.sum(s * _POSITION[: len(s)], dtype=np.uint64, keepdims=True) + _LENGTH[len(s)])[0]
    return out, begin


def shingle_sets(col: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for i, j, data, off in blocks(col):
        sh, begin = shingles(Words(data, off), k)
        for d in range(j - i):
            s = np.sort(sh[begin[d] : begin[d + 1]])
            yield i + d, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
