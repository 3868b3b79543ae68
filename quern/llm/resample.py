"""Importance resampling towards a target: hashed n-gram weights, Gumbel scores, and the k best rows by radix selection.

1. Features of a text are its runs of 1 to N_GRAM words; a feature's bucket is the CRC-32 of its bytes modulo BUCKETS. The
   CRC of a run follows from those of its words (appending bytes is linear over GF(2)), so no run is ever put together.
2. Both corpora are counted by bucket; the BUCKETS gains go to the tasks as one array, and a document's weight is their sum.
3. The k-th best key (score, doc_id) is found digit by digit: each pass counts the rows that share the digits found so far
   by their next digit, at most 2^DIGIT_BITS counts. Only rows up to that key are sorted, in ranges, and ranked.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import text as T
from quern.session import materialise, setting, temporary_tables

BUCKETS, N_GRAM, DIGIT_BITS, RANGE_ROWS, SHORT = 10_000, 3, 12, 1 << 20, 64
LEAST_WORDS, PERCENT, SEED = 20, 5, 42

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """The CRC-32 register after one byte, for each byte (reflected polynomial)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """[n, k, b]: what byte k of a register, being b, becomes after n zero bytes; registers are sums of their bytes."""
    c = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    out = [c]
    for _ in range(SHORT):
        c = _BYTE[c & np.uint32(255)] ^ (c >> np.uint32(8))
        out.append(c)
    return np.array(out)


_SHIFT = _shift_tables()


class Runs:
    """CRC-32 of the words of a block of texts, and of runs of words joined by one space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _LOWER[data]
        words = T.Words(self.data, offsets, hashed=False, letters=_LETTER)
        self.start, self.end, self.first = words.start, words.end, words.first
        self.length = self.end - self.start
        self.words = self._of_words()

    def _of_words(self) -> np.ndarray:
        order = np.argsort(-np.minimum(self.length, SHORT + 1), kind="stable")
        start, length = self.start[order], self.length[order]
        reg = np.full(len(order), _ONES)
        at_least = np.searchsorted(-length, -np.arange(1, SHORT + 1), side="right") if len(order) else np.zeros(SHORT, np.int64)
        n_long = int(np.searchsorted(-np.minimum(length, SHORT + 1), -SHORT, side="left")) if len(order) else 0
        for j in range(SHORT):
            a, b = n_long, int(at_least[j])
            if b <= a:
                break
            r = reg[a:b]
            reg[a:b] = _BYTE[(r ^ self.data[start[a:b] + j]) & np.uint32(255)] ^ (r >> np.uint32(8))
        out = np.empty(len(order), np.uint32)
        out[order] = reg ^ _ONES
        for i in order[:n_long]:
            out[i] = zlib.crc32(self.data[self.start[i] : self.end[i]])
        return out

    def longer(self, runs: np.ndarray, of: np.ndarray) -> np.ndarray:
        """CRCs of the runs with a space and one more word each; of: the number of that word."""
        r = runs ^ _ONES
        spaced = _BYTE[(r ^ np.uint32(0x20)) & np.uint32(255)] ^ (r >> np.uint32(8)) ^ _ONES
        n = self.length[of]
        short = np.minimum(n, SHORT)
        out = self.words[of].copy()
        for k in range(4):
            out ^= _SHIFT[short, k, (spaced >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(n > SHORT):
            w = of[i]
            out[i] = zlib.crc32(self.data[self.start[w] : self.end[w]], int(spaced[i]))
        return out

    def all(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the first word, CRC) of all runs of 1, 2, ... N_GRAM words of one text."""
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.words))  # words from here to the text's end
        at, runs = np.arange(len(self.words)), self.words
        yield at, runs
        for n in range(2, N_GRAM + 1):
            inside = left[at] >= n
            at, runs = at[inside], runs[inside]
            runs = self.longer(runs, at + n - 1)
            yield at, runs


def _counted(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    n = np.zeros(buckets, np.int64)
    for b in T.slices(batches, 0):
        for _, _, data, off in T.blocks(b.column(0)):
            for _, runs in Runs(data, off).all():
                n += np.bincount(runs % np.uint32(buckets), minlength=buckets)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; null and empty texts have none."""
    rows = texts.select(column).mapInArrow(lambda it: _counted(it, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of smoothed frequencies of each bucket, in whole numbers."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def _weighted(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in T.slices(batches, 1):
        for i, j, data, off in T.blocks(b.column(1)):
            r = Runs(data, off)
            of_word = np.zeros(len(r.words) + 1, np.int64)
            for at, runs in r.all():
                of_word[at + 1] += gain[runs % np.uint32(len(gain))]
            total, n = np.cumsum(of_word), np.diff(r.first)
            features = sum(np.maximum(n - k, 0) for k in range(N_GRAM))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(features), pa.array(total[r.first[1:]] - total[r.first[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])


def _gumbel(seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _digit(name: str, lo: int, hi: int) -> tuple[Column, int]:
    """A column's value as a number of so many bits that keeps its order; long values that lie too far apart change sign."""
    if hi - lo < 1 << 63:
        return F.col(name) - F.lit(lo), (hi - lo).bit_length()
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63))), 64


def kth_key(rows: DataFrame, keys: list[tuple[str, bool]], k: int) -> list[int]:
    """Values of the keys (long column, falling) in the k-th row, from 1, in the order of all keys; there are k rows or more.

    No row is sorted or moved: each pass of a column reads the rows left and counts them by one digit.
    """
    out: list[int] = []
    for name, falling in keys:
        lo, hi = rows.agg(F.min(name), F.max(name)).first()
        value, left = _digit(name, lo, hi)
        prefix = 0
        while left:
            step = min(DIGIT_BITS, left)
            left -= step
            own = rows if left + step >= 64 else rows.where(F.shiftrightunsigned(value, left + step) == prefix)
            digit = F.shiftrightunsigned(value, left).bitwiseAND(F.lit((1 << step) - 1))
            for d, n in sorted(map(tuple, own.groupBy(digit.alias("d")).count().collect()), reverse=falling):  # 2^DIGIT_BITS at most
                if k <= n:
                    prefix = prefix << step | d
                    break
                k -= n
        at = lo + prefix if hi - lo < 1 << 63 else prefix - (1 << 63)
        out.append(at)
        rows = rows.where(F.col(name) == at)
    return out


def draw(scored: DataFrame, eligible: str, k: int) -> DataFrame:
    """scored (doc_id, n_features, weight, score, ...) with rank: 1 to k for the k eligible rows of highest score, else null.

    Ties go to the smaller doc_id, and rows that share that too are told apart by n_features and weight, or else any of them
    is taken. Rows without a score are never drawn. Fewer than k rows are all drawn.
    """
    spark = scored.sparkSession
    able = scored.where(f"score IS NOT NULL AND ({eligible})")
    k = min(k, able.count())
    columns = ["doc_id", "n_features", "weight", "score"]
    if k < 1:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    score, doc = kth_key(able, [("score", True), ("doc_id", False)], k)
    taken = F.expr(f"score IS NOT NULL AND ({eligible})") & ((F.col("score") > score) | ((F.col("score") == score) & (F.col("doc_id") <= doc)))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    ranges = scored.where(taken).select(*columns).repartitionByRange(max(1, -(-k // RANGE_ROWS)), *order[:2])
    placed = materialise(ranges.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "drawn")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a range
    ranked = placed.join(F.broadcast(before), part == F.col("__part")).withColumn("rank", F.col("__before") + place + 1)
    ranked = ranked.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~F.coalesce(taken, F.lit(False))).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text, ...), drawn towards target (text, ...).

    Of the N documents with least_words words or more and a doc_id, percent * N / 100 (cut to a whole number) get a rank.
    Null and empty texts have no features and weight 0. A null doc_id has neither hash nor score, and isn't drawn; its text
    counts in the statistics. Rows that repeat are rows of their own, told apart as in draw. An empty table of either kind
    counts as one without features; an empty docs gives an empty result. Further columns are not read. doc_id is an integer.
    """
    spark = docs.sparkSession
    with temporary_tables(spark) as keep, setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2048"):
        gain = gains(bucket_counts(docs), bucket_counts(target))
        held = spark.sparkContext.broadcast(gain)  # BUCKETS numbers
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _weighted(it, held.value), "doc_id long, n_words long, n_features long, weight long")
        scored = materialise(rows.withColumn("score", F.col("weight") + _gumbel(seed)), "scored")
        n = scored.where(f"score IS NOT NULL AND n_words >= {least_words}").count()
        return keep(materialise(draw(scored, f"n_words >= {least_words}", percent * n // 100), "resampled"))
