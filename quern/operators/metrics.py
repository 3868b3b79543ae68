"""Ranking metrics, score roll-ups, length profiles and telemetry aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import quantiles
from quern.operators.corpus import dense_ids
from quern.session import materialise

BLOCK_BYTES, TILE, WIDTH = 16 << 20, 1 << 21, 1024
SORTED, CODES, REPEATS = 1 << 24, 1 << 17, 3


def _grid(queries: DataFrame, docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Rows (i, j, query, id, v and further columns) of every pair of a query and a document block, and the number of the latter."""
    sides = []
    for df, name in ((queries, "query_id"), (docs, "doc_id")):
        v = F.col("v").cast("array<double>")
        rows = df.withColumns({name: F.col(name).cast("long"), "v": v}).withColumnRenamed(name, "id").where("v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
        size = rows.agg(F.sum(F.size("v").cast("long") * 8)).first()[0] or 0
        n = max(1, -(-size // block_bytes))
        sides.append((rows.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n))
    (q, n_q), (d, n_d) = sides
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(F.col("own").alias("i"), every(n_d).alias("j"), F.lit(True).alias("query"), *(c for c in q.columns if c != "own"))
    d = d.select(every(n_q).alias("i"), F.col("own").alias("j"), F.lit(False).alias("query"), *(c for c in d.columns if c != "own"))
    return q.unionByName(d, allowMissingColumns=True), n_d


def blocked_scores(queries: DataFrame, docs: DataFrame, k: int | None = None, block_bytes: int = BLOCK_BYTES, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score): dot products of queries (query_id, v) and docs (doc_id, v) in double precision.

    Both sides are dealt by hash into blocks of about block_bytes, and each pair of blocks is one task's matrix product, in
    tiles of TILE scores; neither side passes the driver, and neither is broadcast. A query block is sent once for each block
    of documents and the other way round; no pair is sent. Without k, pairs come in an order in which files of them are small
    (_pairs). With k, a task returns the k best documents of each of its queries
    (ties by document), and the k best of all tasks are kept. Ids are integers and don't repeat; vectors are of one length, and
    those that are null, or hold a null, are left out. Scores that are no number come last. With digits, scores are rounded
    before they are compared. Where both sides have an integer label as well, rel tells whether labels are equal (1 or 0, null
    where one is).
    """
    rel = "label" in queries.columns and "label" in docs.columns
    rows, n_d = _grid(queries, docs, block_bytes)
    out = rows.groupBy("i", "j").applyInArrow(_scoring(k, digits, rel), "query_id long, doc_id long, score double" + ", rel int" * rel)
    return out if k is None or n_d == 1 else top_k(out, "query_id", "doc_id", "score", k).drop("rank")


def _sides(batches: Iterator[pa.RecordBatch]) -> list[dict[str, np.ndarray]]:
    """Columns of the queries and of the documents of a pair of blocks, documents in rising order; nothing if a side is empty.

    A label that is null is not known.
    """
    held: dict[bool, list[pa.RecordBatch]] = {True: [], False: []}
    for b in batches:
        for side in held:
            if (part := b.filter(pc.equal(b.column("query"), side))).num_rows:
                held[side].append(part)
    out = []
    for side, parts in held.items():
        if not parts:
            return []
        rows = {c: pa.concat_arrays([b.column(c) for b in parts]) for c in parts[0].schema.names if c not in ("i", "j", "query")}
        x = {c: a.to_numpy(zero_copy_only=False) for c, a in rows.items() if c not in ("v", "label")}
        x["v"] = rows["v"].flatten().to_numpy(zero_copy_only=False).reshape(len(rows["v"]), -1)
        if "label" in rows:
            x["label"], x["known"] = rows["label"].fill_null(0).to_numpy(), rows["label"].is_valid().to_numpy(zero_copy_only=False)
        order = np.argsort(x["id"], kind="stable")  # ties go to the smaller document
        out.append(x if side else {c: a[order] for c, a in x.items()})
    return out


def _tiles(q: dict[str, np.ndarray], d: dict[str, np.ndarray], digits: int | None) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]]:
    """Some queries at a time, all documents, and their scores."""
    step = max(1, TILE // len(d["id"]))
    for a in range(0, len(q["id"]), step):
        own = {c: x[a : a + step] for c, x in q.items()}
        s = own["v"] @ d["v"].T
        yield own, d, s if digits is None else _rounded(s, digits)


def _pairs(q: dict[str, np.ndarray], d: dict[str, np.ndarray], digits: int | None) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Some queries and documents, and of all their pairs the rows, columns and scores, up to TILE at a time.

    Ids of few queries and documents are kept as short codes in a file; scores are too, if they are up to CODES. More of them
    take their full width, unless equal ones lie side by side. So where SORTED pairs hold each score REPEATS times or more,
    pairs come by score, else by document.
    """
    width = min(len(d["id"]), max(WIDTH, min(8 * WIDTH, SORTED // len(q["id"]))))
    step = max(1, SORTED // width)
    for b in range(0, len(d["id"]), width):
        part = {c: x[b : b + width] for c, x in d.items()}
        for a in range(0, len(q["id"]), step):
            own = {c: x[a : a + step] for c, x in q.items()}
            s, at = np.empty((len(own["id"]), len(part["id"]))), 0
            for _, _, tile in _tiles(own, part, digits):
                s[at : at + len(tile)] = tile
                at += len(tile)
            n, flat = s.shape[1], s.ravel()
            order = np.argsort(flat) if digits is not None and s.size > REPEATS * CODES else None
            if order is None or not CODES < _distinct(flat, order) <= s.size // REPEATS:
                order = np.concatenate([np.arange(s.size).reshape(s.shape)[:, c : c + WIDTH].ravel() for c in range(0, n, WIDTH)])
            for c in range(0, s.size, TILE):
                places = order[c : c + TILE]
                yield own, part, places // n, places % n, flat[places]


def _distinct(s: np.ndarray, order: np.ndarray) -> int:
    """How many values there are in s, which order sorts."""
    parts = (s[order[a : a + TILE + 1]] for a in range(0, len(s), TILE))
    return 1 + sum(int(np.count_nonzero(x[1:] != x[:-1])) for x in parts)


def _rounded(s: np.ndarray, digits: int) -> np.ndarray:
    """Halves away from zero; what is too large for that, or no number, as it is."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = s * 10.0**digits
        whole = np.trunc(y)
        whole += np.where(np.abs(y - whole) >= 0.5, np.copysign(1.0, y), 0.0)
        return np.where(np.isfinite(whole), whole / 10.0**digits, s)


def _scoring(k: int | None, digits: int | None, rel: bool):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (sides := _sides(batches)):
            return
        every = k is None or len(sides[1]["id"]) <= k
        for own, d, rows, cols, s in _pairs(*sides, digits) if every else _best_pairs(*sides, digits, k):
            out = {"query_id": pa.array(own["id"][rows]), "doc_id": pa.array(d["id"][cols]), "score": pa.array(s)}
            if rel:
                same = own["label"][rows] == d["label"][cols]
                out["rel"] = pa.array(same.astype(np.int32), mask=~(own["known"][rows] & d["known"][cols]))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return _typed(scored)


def _best_pairs(q: dict[str, np.ndarray], d: dict[str, np.ndarray], digits: int | None, k: int) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """The same of the k best documents of each query, of which there are more."""
    for own, d, s in _tiles(q, d, digits):
        falling = -np.where(np.isnan(s), -np.inf, s)
        limit = np.partition(falling, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero(falling <= limit)
        best = np.lexsort((cols, falling[rows, cols], rows))
        rows, cols = rows[best], cols[best]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, cols = rows[first], cols[first]
        yield own, d, rows, cols, s[rows, cols]


def _typed(f: Callable) -> Callable:
    # the iterator form of applyInArrow is chosen by these annotations, which must be classes
    f.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return f


def first_relevant(queries: DataFrame, docs: DataFrame, digits: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, first, pos, neg): the rank of each query's best document of its own label, its score, and the best score of another label.

    Sides are as in blocked_scores, with labels, and a document with a query's id is not counted for it; scores are rounded
    and ties go by document, scores that are no number first. Tasks find the best of each query in their blocks, and once the best of all are
    known, count the documents before it: what is sent is vectors and a row for each query and block, never pairs.
    """
    rows, _ = _grid(queries, docs, block_bytes)
    best = rows.groupBy("i", "j").applyInArrow(_best(digits), "query_id long, pos double, pos_doc long, neg double")
    top = F.max(F.when(F.col("pos_doc").isNotNull(), F.struct("pos", (-F.col("pos_doc")).alias("d"))))
    best = best.groupBy("query_id").agg(top.alias("p"), F.max("neg").alias("neg"))
    best = materialise(best.select("query_id", F.col("p.pos").alias("pos"), (-F.col("p.d")).alias("pos_doc"), "neg"), "best")
    asked = queries.select("query_id", "v").join(best.where("pos_doc IS NOT NULL").select("query_id", "pos", "pos_doc"), "query_id")
    rows, _ = _grid(asked, docs.select("doc_id", "v"), block_bytes)
    before = rows.groupBy("i", "j").applyInArrow(_before(digits), "query_id long, n long").groupBy("query_id").agg((F.sum("n") + 1).alias("first"))
    return best.join(before, "query_id", "left").select("query_id", "first", "pos", "neg")


def _ordered(s: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of s, equal where s is; what is no number comes after infinity."""
    bits = np.where(np.isnan(s), np.nan, s + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.iinfo(np.int64).max)


def _best(digits: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (sides := _sides(batches)):
            return
        for own, d, s in _tiles(*sides, digits):
            key, at = _ordered(s), np.arange(len(s))
            same = own["label"][:, None] == d["label"]
            judged = own["known"][:, None] & d["known"] & (own["id"][:, None] != d["id"])
            found = []
            for mask in (judged & same, judged & ~same):
                first = np.where(mask, key, np.iinfo(np.int64).min).argmax(axis=1)  # of equal ones the smallest document
                found.append((first, ~mask[at, first]))
            (p, no_p), (n, no_n) = found
            columns = [pa.array(own["id"]), pa.array(s[at, p], mask=no_p), pa.array(d["id"][p], mask=no_p), pa.array(s[at, n], mask=no_n)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "pos", "pos_doc", "neg"])

    return _typed(best)


def _before(digits: int):
    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (sides := _sides(batches)):
            return
        for own, d, s in _tiles(*sides, digits):
            key, pos, doc = _ordered(s), _ordered(own["pos"])[:, None], own["pos_doc"].astype(np.int64)[:, None]
            earlier = ((key > pos) | ((key == pos) & (d["id"] < doc))) & (d["id"] != doc) & (d["id"] != own["id"][:, None])
            yield pa.RecordBatch.from_arrays([pa.array(own["id"]), pa.array(earlier.sum(axis=1))], names=["query_id", "n"])

    return _typed(before)


def top_k(scores: DataFrame, query: str, doc: str, score: str, k: int) -> DataFrame:
    """The k best documents of each query with rank from 1; ties by document."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), doc))).where(F.col("rank") <= k)


def ranking(ranked: DataFrame, query: str, relevance: str, n_relevant: DataFrame, k: int) -> DataFrame:
    """ndcg, map, recall, precision, mrr and hit rate at k of each query, for binary relevance (trec_eval's formulas).

    ranked: (query, rank, relevance); n_relevant: (query, n_relevant). Queries without relevant documents are left out.
    """
    top = ranked.where(F.col("rank") <= k).withColumn("__hits", F.sum(relevance).over(Window.partitionBy(query).orderBy("rank")))
    per = top.groupBy(query).agg(
        F.sum(F.col(relevance) / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col(relevance) * F.col("__hits") / F.col("rank")).alias("ap"),
        F.sum(relevance).cast("long").alias("hits"),
        F.min(F.when(F.col(relevance) > 0, F.col("rank"))).alias("first"),
    )
    out = n_relevant.where("n_relevant > 0").join(per, query, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + F.lit(1.0)))
    z = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        query,
        (z(F.col("dcg")) / ideal).alias("ndcg"),
        (z(F.col("ap")) / F.least(F.col("n_relevant"), F.lit(k))).alias("map"),
        (z(F.col("hits")) / F.col("n_relevant")).alias("recall"),
        (z(F.col("hits")) / F.lit(k)).alias("precision"),
        z(1 / F.col("first")).alias("mrr"),
        (z(F.col("hits")) > 0).cast("int").alias("hit"),
    )


def nearest_rank(value: str, q: float) -> Column:
    """sorted[ceil(q n) - 1], as an aggregate that is combined before the shuffle."""
    return F.expr(f"percentile_disc({q}D) WITHIN GROUP (ORDER BY {value})")


def nearest_rank_of(values: Column, q: float) -> Column:
    """The same of an array."""
    return F.element_at(F.sort_array(values), F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(q)).cast("int")))


def length_profile(df: DataFrame, length: Column, by: list[str]) -> DataFrame:
    """n, mean, interpolated p50, p90, p95, p99 (cut to whole numbers), max, and shares over 256 and 512.

    Lengths are counted by value first, so df is read once and a group's quantiles come from its distinct lengths in ranges.
    """
    counts = materialise(df.select(*by, length.alias("__len")).groupBy(*by, "__len").agg(F.count(F.lit(1)).alias("__c")), "lengths")
    shares = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    p = quantiles.interpolated(counts, by, "__len", "__c", **shares).drop("n")
    total = F.sum("__c")
    share = lambda n: F.round(F.sum(F.when(F.col("__len") > n, F.col("__c")).otherwise(0)) / total, 6).alias(f"share_over_{n}")
    out = counts.groupBy(*by).agg(total.alias("n"), F.round(F.sum(F.col("__len") * F.col("__c")) / total, 6).alias("mean_len"), F.max("__len").cast("long").alias("max_len"), share(256), share(512))
    return quantiles.join_groups(out, p, by).withColumns({name: F.floor(F.round(name, 6)) for name in shares})


def category_scores(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """(category, n_tasks, n_missing, score, seconds): unweighted mean with missing tasks as 0; seconds are summed."""
    j = tasks.join(results, "task", "left")
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(F.col("score").isNull()).alias("n_missing"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("score"), F.round(F.sum(F.coalesce("seconds", F.lit(0.0))), 6).alias("seconds"))


def latest(attempts: DataFrame, key: str, seq: str, row: list[str], **conditions: str) -> DataFrame:
    """For each key the latest attempt, and the latest for which each named condition holds."""
    s = F.struct(*row)
    return attempts.groupBy(key).agg(F.max_by(s, seq).alias("latest"), *(F.max_by(F.when(F.expr(c), s), F.when(F.expr(c), F.col(seq))).alias(n) for n, c in conditions.items()))


def smoothed(df: DataFrame, run: str, order: str, value: str, alpha: float) -> DataFrame:
    """(run, n, ema): exponential smoothing in order, from the first value.

    The result is a weighted sum: the weight of a value follows from its place, which dense ids give, so a run of any length
    is summed in parts.
    """
    rows = dense_ids(df.select(run, order, value), [order], "__i", [run])
    n = df.groupBy(F.col(run).alias("__run")).agg(F.count(F.lit(1)).alias("n"))
    j = rows.join(n, F.col(run).eqNullSafe(F.col("__run")))
    weight = F.pow(F.lit(1.0 - alpha), F.col("n") - 1 - F.col("__i")) * F.when(F.col("__i") == 0, 1.0).otherwise(alpha)
    return j.groupBy(run).agg(F.first("n").alias("n"), F.sum(weight * F.col(value)).alias("ema"))


RATES = tuple(i / 10 for i in range(10))


def confidences(ranked: DataFrame, query: str, score: str) -> DataFrame:
    """(query, max, std, diff1) of each query's scores: the best, their population deviation, the best less the second best."""
    two = ranked.where(F.col("rank") <= 2).groupBy(query).agg(F.max(score).alias("max"), F.when(F.count(F.lit(1)) > 1, F.max(score) - F.min(score)).otherwise(0.0).alias("diff1"))
    return ranked.groupBy(query).agg(F.stddev_pop(score).alias("std")).join(two, query).select(query, "max", "std", "diff1")


def _abstention(df: DataFrame, order: list[str], values: list[str], cuts: list[int]) -> dict[str, list[float]]:
    """For each value its means over all rows but the first so many in order, from one pass over the ranked rows."""
    ranked = dense_ids(df.select(*dict.fromkeys([*order, *values])), order, "__place")
    row = ranked.agg(*(F.avg(F.when(F.col("__place") >= c, F.col(v))).alias(f"{v}__{i}") for v in values for i, c in enumerate(cuts))).first()
    return {v: [row[f"{v}__{i}"] for i in range(len(cuts))] for v in values}


def nauc(per_query: DataFrame, query: str, metrics: list[str], confidence: list[str]) -> DataFrame:
    """(metric, confidence, nauc): how much of the possible gain comes from leaving out the queries of least confidence.

    The abstention curve has a metric's mean over the queries left when the RATES least confident ones are out. The area
    under it, less that of the flat curve, is divided by what the best order (by the metric itself) gains; null where nothing
    can be gained. Queries are ranked in ranges and the curves' means are aggregates, so no task or driver holds them; ties
    go to the smaller query. Null metrics count as 0; an empty table gives nulls.
    """
    rows = materialise(per_query.select(query, *confidence, *(F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in metrics)), "per_query")
    n = rows.count()
    cuts = [min(round(r * n), n - 1) for r in RATES]
    area = lambda curve: sum((b - a) * (x + y) / 2 for a, b, x, y in zip(RATES, RATES[1:], curve, curve[1:]))
    best = {m: _abstention(rows, [m, query], [m], cuts)[m] for m in metrics} if n else {}
    out = []
    for c in confidence:
        curves = _abstention(rows, [c, query], metrics, cuts) if n else {}
        for m in metrics:
            flat = best[m][0] * (RATES[-1] - RATES[0]) if n else 0.0
            gain = area(best[m]) - flat if n else 0.0
            out.append((m, c, round((area(curves[m]) - flat) / gain, 6) if abs(gain) > 1e-12 else None))
    return per_query.sparkSession.createDataFrame(out, "metric string, confidence string, nauc double")
