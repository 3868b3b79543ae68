"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. Each text becomes a few shares (letters, capitals, marks, digits, repeated words and lines ...) and one word evidence: the
   mean over its words and word pairs, hashed into GRAMS buckets, of the log-ratio of their rates in good and bad labelled
   documents. A logistic regression on labelled documents turns them into a probability; for it, each labelled document
   takes its word evidence from the other half of them. At most LABELLED labelled rows are read.
2. Probabilities are summed by path (host and language) and by host, in grouped aggregations. Beta priors are fitted by
   moments: hosts shrink towards the global rate, paths towards their host.
3. A document's log-odds are the classifier's, moved by its path's shrunk rate against the global one, where the document's
   own part is taken out of the rates. How far is fitted to the labelled documents. Under 0.5 it is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import text as T
from quern.llm.groups import join_groups
from quern.llm.url_rules import host_and_path
from quern.session import materialise, temporary_tables

LABELLED, RIDGE, STEPS, GRAMS, SMOOTH, SITE_WEIGHT, SITE_PRIOR = 50_000, 1e-3, 30, 1 << 13, 0.1, 0.5, 16.0
_SETS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"|", b"#*$%&", b"<>/\\", b"\n", b"@_=+~^", b"()[]{}\"'")
_CLASS = np.zeros(256, np.uint8)
for _i, _s in enumerate(_SETS):
    _CLASS[list(_s)] = _i + 1
WIDTH = 2 * (len(_SETS) + 7) + 2


def _grams(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word, and of each pair of neighbours (the last word of a text has no pair: GRAMS)."""
    shift = np.uint64(64 - int(GRAMS).bit_length() + 1)
    pair = np.full(len(w.hash), GRAMS, np.int64)
    if len(w.hash) > 1:
        pair[:-1] = (T.mix(w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:]) >> shift).astype(np.int64)
        ends = w.first[1:] - 1
        pair[ends[ends >= 0]] = GRAMS
    return (w.hash >> shift).astype(np.int64), pair


def word_counts(col: pa.Array) -> Iterator[np.ndarray]:
    """The share of each bucket among a text's words and pairs, for each text in turn."""
    for i, j, data, off in T.blocks(col):
        w = T.Words(data, off)
        one, two = _grams(w)
        for a, b in zip(w.first[:-1], w.first[1:]):
            n = np.bincount(np.concatenate([one[a:b], two[a:b]]), minlength=GRAMS + 1)[:GRAMS]
            yield n / max(1, n.sum())


def features(col: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """One row of WIDTH numbers for each text: shares and their square roots, the length's logarithm, and the word evidence."""
    out = np.zeros((len(col), WIDTH), np.float32)
    table = np.append(ratios, 0.0)
    for i, j, data, off in T.blocks(col):
        size = np.maximum(np.diff(off), 1)
        kinds, part = _CLASS[data], []
        for k in range(len(_SETS)):
            total = np.concatenate([[0], np.cumsum(kinds == k + 1, dtype=np.int64)])
            part.append((total[off[1:]] - total[off[:-1]]) / size)
        w = T.Words(data, off)
        n = w.counts()
        many = np.maximum(n, 1)
        doc = w.doc_of_word()
        same = np.zeros(len(w.hash), bool)
        if len(same) > 1:
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        span = np.bincount(doc, weights=w.end - w.start, minlength=j - i)
        bad = np.isin(data[w.end - 1], np.frombuffer(b"#*$%&!|", np.uint8)) if len(w.end) else np.zeros(0, bool)
        distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:])])
        lines = [data[a:b].tobytes().split(b"\n") for a, b in zip(off[:-1], off[1:])]
        part += [
            np.bincount(doc, weights=same, minlength=j - i) / many,
            1 - distinct / many,
            np.minimum(span / many, 40) / 40,
            np.bincount(doc, weights=bad, minlength=j - i) / many,
            np.array([1 - len(set(x)) / len(x) for x in lines]),
            np.array([min(1.0, len(x) / 200) for x in lines]),
            (n < 50).astype(float),
        ]
        rows = np.stack(part, 1)
        one, two = _grams(w)
        evidence = np.bincount(doc, weights=table[one] + table[two], minlength=j - i) / np.maximum(2 * n - 1, 1)
        out[i:j] = np.concatenate([rows, np.sqrt(np.maximum(rows, 0)), np.log1p(n)[:, None] / 10, evidence[:, None]], 1)
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, ratios: np.ndarray | None = None, site_weight: float = 0.0):
        self.mean, self.scale, self.weight, self.site_weight = mean, scale, weight, site_weight
        self.ratios = np.zeros(GRAMS) if ratios is None else ratios

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1], -12, 12)


def log_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log-ratio of each bucket's rate in good and bad documents, from sums of shares; 0 for all where one kind is missing."""
    if not good.sum() or not bad.sum():
        return np.zeros(GRAMS)
    g, b = (np.log((x + SMOOTH) / (x.sum() + SMOOTH * GRAMS)) for x in (good, bad))
    return g - b


def fit_site_weight(logit: np.ndarray, moved: np.ndarray, y: np.ndarray) -> float:
    """The factor of the sites' log-odds with the highest posterior, from 0 to 1; a normal prior around SITE_WEIGHT of precision SITE_PRIOR."""
    b = SITE_WEIGHT
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(logit + b * moved, -30, 30)))
        step = ((y - p) @ moved - SITE_PRIOR * (b - SITE_WEIGHT)) / ((p * (1 - p)) @ moved**2 + SITE_PRIOR)
        b = min(1.0, max(0.0, b + step))
        if abs(step) < 1e-9:
            break
    return float(b)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Ridge-penalised logistic regression by Newton's method; y > 0 is good. Under ten rows, or one class: even odds for every text."""
    y = (y > 0).astype(float)
    if len(y) < 10 or y.min() == y.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH + 1))
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.append((x - mean) / scale, np.ones((len(x), 1)), 1)
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + RIDGE * len(z) * np.eye(len(w)), z.T @ (y - p) - RIDGE * len(z) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of shares of buckets, of good and bad documents of either half: one row of a task."""
    out = np.zeros((2, 2, GRAMS))
    for b in T.slices(batches, 2):
        for quality, half, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_counts(b.column(2))):
            out[half, int(quality > 0)] += x
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["sums"])


def _featured(batches: Iterator[pa.RecordBatch], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Features of labelled rows (keys, half, text), each with the ratios of the other half."""
    for b in T.slices(batches, 4):
        half = b.column(3).to_numpy()
        x = np.where(half[:, None] == 0, features(b.column(4), ratios[1]), features(b.column(4), ratios[0]))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))], names=["quality", "host", "path", "x"])


def labelled(docs: DataFrame, labels: DataFrame, host: str, path: str) -> DataFrame:
    """(quality, host, path, half, text) of the rows that labels (doc_id, quality) cover, written; of more than LABELLED labels, those of least hash.

    Of several labels of a document the highest counts. Rows that repeat a labelled doc_id count each, up to LABELLED rows.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__doc_id")).agg(F.max("quality").cast("double").alias("__quality"))
    known = materialise(known, "labels")
    share = (LABELLED - 4 * LABELLED**0.5) / max(1, known.count())
    known = known.where(F.pmod(F.xxhash64("__doc_id"), F.lit(1 << 30)) / float(1 << 30) < share) if share < 1 else known
    rows = docs.join(F.broadcast(known), docs.doc_id == F.col("__doc_id"))  # about LABELLED pairs of numbers
    half = F.pmod(F.xxhash64(F.concat_ws("|", F.lit("half"), F.col("__doc_id"))), F.lit(2)).cast("int")
    rows = rows.select(F.col("__quality").alias("quality"), F.col(host).alias("host"), F.col(path).alias("path"), half.alias("half"), "text")
    rows = materialise(rows, "labelled")
    return rows if rows.count() <= LABELLED else materialise(rows.orderBy(F.xxhash64("text"), "half").limit(LABELLED), "labelled")


def train(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model fitted on labelled rows, without a site weight, and (quality, host, path, x) of these rows, written."""
    sums = np.zeros((2, 2, GRAMS))
    for r in rows.coalesce(16).select("quality", "half", "text").mapInArrow(_counted, "sums binary").collect():  # 16 rows of fixed size
        sums += np.frombuffer(r["sums"]).reshape(sums.shape)
    ratios = np.stack([log_ratios(sums[h, 1], sums[h, 0]) for h in (0, 1)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("host", "path").schema)
    x = rows.select("quality", "host", "path", "half", "text").mapInArrow(lambda it: _featured(it, ratios), f"quality double, {kinds}, x array<float>")
    x = materialise(x, "features")
    got = x.select("quality", "x").toArrow()  # at most LABELLED rows of WIDTH numbers
    y = got["quality"].to_numpy().astype(float)
    values = pc.list_flatten(got["x"]).to_numpy().astype(np.float64).reshape(len(y), WIDTH)
    order = np.lexsort((*values.T, y))
    model = fit(values[order], y[order])
    model.ratios = log_ratios(sums[:, 1].sum(0), sums[:, 0].sum(0))
    return model, x


def _scored(batches: Iterator[pa.RecordBatch], model: Model, at: int, text: bool) -> Iterator[pa.RecordBatch]:
    for b in T.slices(batches, at):
        logit = pa.array(model.logit(features(b.column(at), model.ratios).astype(np.float64)))
        held = [i for i in range(b.num_columns) if text or i != at]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in held), logit], names=[*(b.schema.names[i] for i in held), "__logit"])


def scored(docs: DataFrame, model: Model, text: bool = True) -> DataFrame:
    """docs (text, ...) with __logit, the classifier's log-odds; without the text itself if so wanted."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if text or f.name != "text")
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _scored(it, model, at, text), f"{kinds}, __logit double")


def site_rates(scored: DataFrame, host: str, path: str) -> DataFrame:
    """One row a path: host, path, n and s (documents and sum of probabilities), host_n and host_s, global_rate, the priors'
    weights host_w and path_w, and host_rate and path_rate, shrunk by these fitted beta priors.

    A prior's weight is m (1 - m) / v - 1 for the mean m and variance v of the rates below it, from 1 to 10,000.
    """
    p = 1 / (1 + F.exp(-F.col("__logit")))
    paths = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.var_pop(F.col("s") / F.col("n")).alias("path_v"))
    weight = lambda m, v: F.when(v > 0, F.least(F.lit(1e4), F.greatest(F.lit(1.0), m * (1 - m) / v - 1))).otherwise(F.lit(1e4))
    every = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("global_rate"), F.var_pop(F.col("host_s") / F.col("host_n")).alias("host_v"), F.avg("path_v").alias("path_v_mean"))
    hosts = hosts.join(F.broadcast(every))  # one row
    hosts = hosts.withColumn("host_w", weight(F.col("global_rate"), F.col("host_v")))
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + F.col("host_w") * F.col("global_rate")) / (F.col("host_n") + F.col("host_w"))).withColumnRenamed("host", "__host")
    out = paths.join(hosts, paths.host.eqNullSafe(hosts["__host"]))
    out = out.withColumn("path_w", weight(F.col("host_rate"), F.col("path_v_mean")))
    rate = (F.col("s") + F.col("path_w") * F.col("host_rate")) / (F.col("n") + F.col("path_w"))
    return out.select("host", "path", "n", "s", "host_n", "host_s", "global_rate", "host_w", "path_w", "host_rate", rate.alias("path_rate"))


def _logit(rate: Column) -> Column:
    rate = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), rate))
    return F.log(rate / (1 - rate))


def judged(rows: DataFrame, sites: DataFrame, host: str, path: str) -> DataFrame:
    """rows (__logit, host, path, ...) with __host_rate and __path_rate, the rates of all other documents of its host and path,
    shrunk by the priors, and __moved, the log-odds of its path's rate less those of the global one."""
    sites = sites.select(*(F.col(c).alias(f"__{c}") for c in sites.columns))
    j = join_groups(rows, sites, [(host, "__host"), (path, "__path")], "__n")
    p = 1 / (1 + F.exp(-F.col("__logit")))
    j = j.withColumn("__host_rate", (F.greatest(F.col("__host_s") - p, F.lit(0.0)) + F.col("__host_w") * F.col("__global_rate")) / (F.col("__host_n") - 1 + F.col("__host_w")))
    j = j.withColumn("__path_rate", (F.greatest(F.col("__s") - p, F.lit(0.0)) + F.col("__path_w") * F.col("__host_rate")) / (F.col("__n") - 1 + F.col("__path_w")))
    return j.withColumn("__moved", _logit(F.col("__path_rate")) - _logit(F.col("__global_rate")))


def _evidence(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, WIDTH)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(model.logit(x))], names=["quality", "host", "path", "__logit"])


def site_weight(model: Model, known: DataFrame, sites: DataFrame) -> float:
    """fit_site_weight on labelled rows (quality, host, path, x); 0 where nothing could be learned from them."""
    if not model.weight.any():
        return 0.0
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.select("host", "path").schema)
    rows = known.select("quality", "host", "path", "x").mapInArrow(lambda it: _evidence(it, model), f"quality double, {kinds}, __logit double")
    got = judged(rows, sites, "host", "path").select("quality", "__logit", "__moved").toArrow()  # at most LABELLED rows
    y, logit, moved = (got.column(i).to_numpy() for i in range(3))
    order = np.lexsort((moved, logit, y))
    return fit_site_weight(logit[order], moved[order], (y[order] > 0).astype(float))


def url_levels(url: str) -> tuple[Column, Column]:
    """Host and first segment of the path (like /en) of a url column: the levels at which sites are shrunk.

    Both are empty where it is null or has no ://, so such rows are one site.
    """
    host, path = host_and_path(url)
    return host, F.regexp_extract(path, "^/[^/]*", 0)


def _quality(weight: float) -> Column:
    return F.round(1 / (1 + F.exp(-(F.col("__logit") + weight * F.col("__moved")))), 6)


def _fitted(docs: DataFrame, labels: DataFrame, host: str, path: str, text: bool = True) -> tuple[DataFrame, DataFrame, float]:
    """docs with __logit and the rates of their sites, written, and the sites' weight."""
    with temporary_tables(docs.sparkSession) as keep:
        model, known = train(labelled(docs, labels, host, path))
        rows = keep(materialise(scored(docs, model, text), "scored"))
        sites = keep(materialise(site_rates(rows, host, path), "sites"))
        return rows, sites, site_weight(model, known, sites)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", url: str | None = None) -> DataFrame:
    """(doc_id, doc_score, host_rate, path_rate, quality, kept) of every row of docs; the rates are those of the other documents.

    With url, a column of docs, hosts and paths are its url_levels; else they are the columns host and path.
    Null texts count as empty, null hosts and paths as one of their own. With under ten labels, or labels of one class, every
    quality is 0.5 and all are kept. Rows that repeat are judged alike and each counts in its site; an empty table gives an
    empty result; further columns are not read.
    """
    site = (F.col(host), F.col(path)) if url is None else url_levels(url)
    docs = docs.select("doc_id", site[0].alias("host"), site[1].alias("path"), "text")
    rows, sites, weight = _fitted(docs, labels, "host", "path", text=False)
    out = judged(rows, sites, "host", "path").withColumn("quality", _quality(weight))
    return out.select("doc_id", F.round(1 / (1 + F.exp(-F.col("__logit"))), 6).alias("doc_score"), F.round("__host_rate", 6).alias("host_rate"), F.round("__path_rate", 6).alias("path_rate"), "quality", (F.col("quality") >= 0.5).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", url: str | None = None) -> DataFrame:
    """The rows of docs that classify keeps, with the columns of docs; those may have any name that doesn't begin with __.

    Nulls, repeated rows, too few labels and an empty table are taken as by classify. Each text is scored once.
    """
    columns = docs.columns
    if url is not None:
        host, path = "__url_host", "__url_path"
        docs = docs.withColumns(dict(zip((host, path), url_levels(url))))
    rows, sites, weight = _fitted(docs, labels, host, path)
    out = judged(rows, sites, host, path).withColumn("__quality", _quality(weight))
    return out.where("__quality >= 0.5").select(*columns)
