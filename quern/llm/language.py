"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Subwords are byte 2-, 3- and 4-grams of the lower-cased text (every byte outside letters counts as a space), hashed into
BUCKETS rows of an embedding. A document is the mean of its subwords' embeddings, so its logits are the mean of one
precomputed row of logits per subword, and whole texts of any length are scored in blocks. With more than DIM languages the
mean of the embeddings comes first and the linear layer after it, which is the same, so a model is never wider than DIM.

Training reads a bounded sample: rows whose hashed doc_id falls below a share of the hash range that gives about
SAMPLE_PER_LANGUAGE rows a language (fewer where that is over SAMPLE rows, but 8), and at most twice that, as bucket counts;
texts stay on the executors. There may be any number of languages; the driver holds a name, a count and DIM numbers of each.
A fifth of the sample is held back to fit the temperature of the softmax and the score below which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import text as T
from quern.session import materialise, temporary_tables

BUCKETS, DIM, EPOCHS, RATE, SAMPLE_PER_LANGUAGE, SAMPLE, REJECTED_SHARE = 1 << 14, 16, 6, 0.5, 400, 8000, 0.01
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_U = np.uint32


def _grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the 2-, 3- and 4-gram that starts at each byte (of the last bytes: with zeros after)."""
    x = np.concatenate([_FOLD[data], np.zeros(3, np.uint8)]).astype(np.uint32)
    n = len(data)
    two = x[:-1] | x[1:] << _U(8)
    for salt, key in ((0x2545F491, two[:n]), (0x9E3779B1, two[:n] | x[2 : n + 2] << _U(16)), (0x85EBCA77, two[:n] | two[2 : n + 2] << _U(16))):
        yield ((key * _U(salt)) ^ (key >> _U(7)) * _U(0x27D4EB2F)) * _U(0x165667B1) >> _U(32 - int(BUCKETS).bit_length() + 1)


def _spans(off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of whole grams of each document; a shorter document has its first byte's gram alone."""
    return off[:-1], np.maximum(off[1:] - width + 1, np.minimum(off[:-1] + 1, off[1:]))


def _own(data: np.ndarray) -> np.ndarray:
    """Buckets of one text's grams; of a text shorter than a gram, its first byte's with zeros after."""
    return np.concatenate([g[: max(len(data) - w - 1, 1)] for w, g in enumerate(_grams(data))])


SHORT = 4  # texts of fewer bytes are taken by themselves, as their grams would reach into the next text of a block


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in T.slices(batches, 1):
        ids, values = [], []
        for i, j, data, off in T.blocks(b.column(1)):
            grams = list(_grams(data))
            for d in range(j - i):
                counts = np.zeros(BUCKETS, np.int64)
                own = data[off[d] : off[d + 1]]
                if 0 < len(own) < SHORT:
                    counts += np.bincount(_own(own), minlength=BUCKETS)
                else:
                    for w, g in enumerate(grams):
                        s, e = (x[d] for x in _spans(off, w + 2))
                        counts += np.bincount(g[s:e], minlength=BUCKETS)
                at = np.flatnonzero(counts)
                ids.append(at.astype(np.int32))
                values.append((counts[at] / max(1, counts.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "ids", "weights"])


class Model:
    """table has a row of logits of each bucket, or with head, which maps means to logits, its embedding."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, threshold: float, head: np.ndarray | None = None):
        self.labels, self.table, self.bias, self.temperature, self.threshold, self.head = labels, table, bias, temperature, threshold, head

    def best(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and probability of the best label of each row; a slice of rows at a time, so that there are a few million logits at most."""
        label, score = np.zeros(len(means), np.int64), np.zeros(len(means))
        step = max(1, (1 << 22) // len(self.labels))
        for i in range(0, len(means), step):
            z = means[i : i + step]
            p = _softmax(((z if self.head is None else z @ self.head) + self.bias) / self.temperature)
            label[i : i + step] = p.argmax(1)
            score[i : i + step] = p.max(1)
        return label, score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """rows: (language, buckets, weights). None without rows; under 50 rows the temperature is 1 and nothing is rejected."""
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    of = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = rows[: len(rows) // 5] if len(rows) >= 50 else []
    train = rows[len(held) :]
    emb, out, bias = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)), np.zeros((DIM, len(labels))), np.zeros(len(labels))
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            lang, ids, w = train[i]
            rate = RATE * (1 - done / steps)
            done += 1
            h = w @ emb[ids]
            g = _softmax(h @ out + bias)
            g[of[lang]] -= 1
            grad = out @ g
            out -= rate * np.outer(h, g)
            bias -= 0.1 * rate * g
            emb[ids] -= (rate * len(ids) ** 0.5) * w[:, None] * grad
    table, head = (emb @ out, None) if len(labels) <= DIM else (emb, out)
    temperature, threshold = 1.0, 0.0
    if held:
        z = np.array([w @ table[ids] for _, ids, w in held])
        z = (z if head is None else z @ head) + bias
        y = np.array([of[r[0]] for r in held])
        temperature = min(np.geomspace(0.02, 5, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean())
        p = _softmax(z / temperature)
        right = p.argmax(1) == y
        threshold = float(np.quantile(p.max(1)[right], REJECTED_SHARE)) if right.any() else 0.0
    return Model(labels, table.astype(np.float32), bias.astype(np.float32), float(temperature), threshold, head)


def train(docs: DataFrame, allowed: str = "true") -> Model | None:
    """Fit on rows of docs (doc_id, text, lang, ...) with text and lang for which the SQL condition allowed holds.

    Rows for which it is null, as those with a null doc_id under a condition on it, are not read.
    """
    rows = docs.where(F.expr(allowed)).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    with temporary_tables(docs.sparkSession):
        counts = materialise(rows.groupBy(F.col("lang").alias("__lang")).count(), "languages")
        if not (n := counts.count()):
            return None
        each = max(8, min(SAMPLE_PER_LANGUAGE, SAMPLE // n))
        place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
        drawn = rows.join(counts, F.col("lang") == F.col("__lang")).where(place < F.least(F.lit(1.0), each / F.col("count")))
        got = drawn.select("lang", "text").mapInArrow(_features, "lang string, ids array<int>, weights array<float>").limit(2 * each * n).toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by("lang")
    rows = [(a, b.values.to_numpy(), c.values.to_numpy().astype(np.float64)) for a, b, c in zip(got["lang"].to_pylist(), got["ids"], got["weights"])]
    return fit(sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes())))


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for b in T.slices(batches, 1):
        n = b.num_rows
        lang, score = np.full(n, "und", object), np.zeros(n)
        # so that the rows of the table for a block's subwords take 32 MB at most
        most = min(T.BLOCK_BYTES, (1 << 23) // model.table.shape[1]) if model else 0
        for i, j, data, off in T.blocks(b.column(1), most) if model else ():
            letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
            letters = letters[off[1:]] > letters[off[:-1]]
            for d in np.flatnonzero(~letters & (off[1:] > off[:-1])):
                letters[d] = any(c.isalpha() for c in data[off[d] : off[d + 1]].tobytes().decode())
            total, seen = np.zeros((j - i, model.table.shape[1])), np.zeros(j - i)
            size = off[1:] - off[:-1]
            live = np.flatnonzero(size >= SHORT)
            for d in np.flatnonzero((size > 0) & (size < SHORT)):
                own = _own(data[off[d] : off[d + 1]])
                total[d], seen[d] = model.table[own].sum(0), len(own)
            if len(data) > most:  # one long text: its subwords are counted, a chunk at a time
                counts = np.zeros(BUCKETS, np.int64)
                for a in range(0, len(data), most):
                    for w, g in enumerate(_grams(data[a : a + most + 3])):
                        _, e = _spans(np.array([0, len(data)]), w + 2)
                        counts += np.bincount(g[: max(0, min(most, e[0] - a))], minlength=BUCKETS)
                total[0], seen[0] = counts @ model.table.astype(np.float64), counts.sum()
            else:
                for w, g in enumerate(_grams(data)):
                    s, e = _spans(off, w + 2)
                    # rows between a document's last whole gram and the next document's start are summed apart and dropped
                    edges = np.stack([s[live], e[live]], 1).ravel()
                    last = len(edges) - 1 if len(edges) and edges[-1] >= len(g) else len(edges)
                    if len(live):
                        total[live] += np.add.reduceat(model.table[g], edges[:last], axis=0)[::2]
                    seen[live] += (e - s)[live]
            best, p = model.best(total / np.maximum(seen, 1)[:, None])
            lang[i:j] = np.where(letters, np.array(model.labels, object)[best], "und")
            score[i:j] = np.where(letters, p, 0.0)
        accepted = (lang != "und") & (score >= (model.threshold if model else 0))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted.astype(bool))], names=["doc_id", "lang_pred", "score", "accepted"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row of docs; lang_pred is und and score 0 without text or letters.

    accepted is false below the calibrated score (with under 50 rows to learn from: never, but without a language). Texts
    alone decide: equal texts have equal predictions, and rows that repeat are predicted each. Without a model (nothing to
    learn from, an empty table) every prediction is und. Further columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers at most, and DIM a language
    return docs.select("doc_id", "text").mapInArrow(lambda it: _predict(it, held.value), f"doc_id {kind}, lang_pred string, score double, accepted boolean")
