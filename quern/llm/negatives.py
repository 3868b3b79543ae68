"""Hard negatives by norm-bucketed search for the largest inner products.

1. Vectors are scaled to whole numbers, so scores are exact. Candidates are sorted by falling norm, in ranges, and packed into
   buckets of BUCKET_BYTES with their largest norm; consecutive buckets form chunks of CHUNK_BYTES. Anchors are packed into
   blocks in the same way.
2. A search asks for the k best candidates of each anchor in each of its windows (lo to hi). Chunks are taken in rounds of
   doubling number, from the largest norms down. After a round the windows' k-th scores so far are known; a chunk is sent to
   a block in the next round only if the product of norms, which bounds the score (Cauchy-Schwarz), reaches the lower limit
   or k-th score of one of the block's windows. Inside a task the same bound skips buckets and rows of anchors, and the k-th
   score runs on from bucket to bucket.
3. The first search finds an anchor's positives; each of these sets a window for the second one, which finds the negatives.

A task holds one chunk and one group of blocks, at most CHUNK_BYTES + GROUP_BYTES (and a bucket and block more).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialise, temporary_tables

BUCKET_BYTES, BLOCK_BYTES, CHUNK_BYTES, GROUP_BYTES, RANGE_BYTES, MOST_ROWS, DENSE = 1 << 20, 1 << 18, 1 << 24, 1 << 24, 1 << 26, 1 << 16, 64
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
_FAR = 1 << 62

_ROW = "vec_id long, label long, length int, width int, norm double, v binary"


def _scaled(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """Usable vectors as whole numbers, of 4 bytes each, or 8 where these don't hold them."""
    for b in batches:
        b = pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2)], names=["id", "label", "v"]).filter(pc.is_valid(b.column(2)))
        col = b.column(2)
        n = pc.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
        x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        stop = np.cumsum(n)
        with np.errstate(all="ignore"):
            x = np.floor(scale * x)
        full = np.flatnonzero(n)
        norm, most = np.zeros(len(n)), np.zeros(len(n))
        if len(full):
            begin = (stop - n)[full]
            with np.errstate(all="ignore"):
                norm[full], most[full] = np.sqrt(np.add.reduceat(x * x, begin)), np.maximum.reduceat(np.abs(x), begin)
        ok = np.flatnonzero(norm < 2.0**31)  # not for null or non-finite components
        width = np.where(most < 2.0**31 - 1, 4, 8)
        raw = [x[stop[i] - n[i] : stop[i]].astype(np.int32 if width[i] == 4 else np.int64).tobytes() for i in ok]
        at = pa.array(ok)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(n[ok].astype(np.int32)), pa.array(width[ok].astype(np.int32)), pa.array(norm[ok]), pa.array(raw, pa.binary())], names=["vec_id", "label", "length", "width", "norm", "v"])


_PACKED = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("length", pa.int32()), ("width", pa.int32()), ("n", pa.int64()), ("top", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("v", pa.binary())])
_PACKED_DDL = "part int, seq long, length int, width int, n long, top double, ids binary, labels binary, v binary"


def _packs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows in packs of one length and width; rows that are equal in all come once."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    seq, size, kind, last = 0, 0, None, None
    ids: list[int] = []
    labels: list[int] = []
    held: list[bytes] = []
    top = 0.0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "length": kind[0], "width": kind[1], "n": len(ids), "top": top, "ids": np.array(ids, np.int64).tobytes(), "labels": np.array(labels, np.int64).tobytes(), "v": b"".join(held)}], schema=_PACKED)

    for b in batches:
        for i, label, length, width, norm, v in zip(*(b.column(c).to_pylist() for c in range(6))):
            if (i, label, v) == last:
                continue
            if ids and ((length, width) != kind or size >= most or len(ids) >= MOST_ROWS):
                yield flush()
                seq, size, ids, labels, held = seq + 1, 0, [], [], []
            if not ids:
                kind, top = (length, width), norm
            ids.append(i)
            labels.append(label)
            held.append(v)
            size += len(v)
            last = (i, label, v)
    if ids:
        yield flush()


def _packed(rows: DataFrame, most: int, group: int, name: str) -> DataFrame:
    """Packs of rows by falling norm, with the number of the group (of about so many bytes) of one length that holds them."""
    total = rows.agg(F.sum(F.length("v"))).first()[0] or 0
    order = ["length", F.desc("norm"), "vec_id"]
    dealt = rows.repartitionByRange(max(1, -(-total // RANGE_BYTES)), *order).sortWithinPartitions(*order, "label", "v")
    packs = materialise(dealt.mapInArrow(lambda it: _packs(it, most), _PACKED_DDL), name)
    sizes = packs.select("part", "seq", "length", F.length("v").cast("long").alias("size"))
    parts = sizes.groupBy("length", "part").agg(F.sum("size").alias("own"))
    parts = parts.select("length", "part", (F.sum("own").over(Window.partitionBy("length").orderBy("part")) - F.col("own")).alias("before"))  # a row a range
    inner = F.sum("size").over(Window.partitionBy("length", "part").orderBy("seq")) - F.col("size")
    groups = sizes.withColumn("within", inner).join(parts, ["length", "part"]).select("part", "seq", F.expr(f"(before + within) div {group}").cast("int").alias("group"))
    return materialise(packs.join(groups, ["part", "seq"]), name)


class Kept:
    """The k best scores of each of n windows so far; ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.at, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray, need: np.ndarray) -> None:
        """Take in scores of windows at; need is raised to the k-th score of a window that has k."""
        at, ids, scores = np.concatenate([self.at, at]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        self.at, self.ids, self.scores = (x[place < self.k] for x in (at, ids, scores))
        full = self.at[(last := np.flatnonzero(place[place < self.k] == self.k - 1))]
        need[full] = np.maximum(need[full], self.scores[last])


def _matrix(raw: bytes, length: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if width == 4 else np.int64).reshape(-1, length) if length else np.zeros((0, 0), np.int32)


def _exact(bound: float) -> type:
    """The fastest type in which all partial sums of products of whole numbers up to the bound are exact."""
    return np.float32 if bound < 2.0**24 else np.float64 if bound < 2.0**53 else np.int64


def _search_block(block: dict, buckets: list[dict], k: int, same: bool) -> tuple[dict, Kept]:
    wants = {c: np.array([w[c] for w in block["wants"]], np.int64) for c in ("place", "slot", "need", "hi")}
    place, need, hi = wants["place"], wants["need"].copy(), wants["hi"]
    ids, labels = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["labels"], np.int64)
    n, length = len(ids), block["length"]
    x = _matrix(block["v"], length, block["width"]) if length else np.zeros((n, 0), np.int32)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    slots = [np.flatnonzero(wants["slot"] == s) for s in np.unique(wants["slot"])]  # windows, one of an anchor at most
    kept = Kept(len(place), k)
    for b in buckets:
        least, most = np.full(n, _FAR), np.full(n, -_FAR)
        np.minimum.at(least, place, need)
        np.maximum.at(most, place, hi)
        live = np.flatnonzero((norm * b["top"] * (1 + 1e-9) >= least) & (most >= least))
        if not len(live):
            continue
        kind = _exact(norm[live].max() * b["top"] * (1 + 1e-9) + 1)
        other, other_labels = b["id"], b["label"]
        y = b["x"]
        s = x[live].astype(kind) @ y.astype(kind).T
        near = (2.0**53) if kind is not np.int64 else _FAR
        bounded = lambda v: np.clip(v, -near, near).astype(np.float64 if kind is not np.int64 else np.int64)
        allowed = (labels[live][:, None] == other_labels) == same
        allowed &= ids[live][:, None] != other
        row_of = np.full(n, -1)
        row_of[live] = np.arange(len(live))
        for w in slots:
            w = w[row_of[place[w]] >= 0]
            rows = row_of[place[w]]
            own = s if len(rows) == len(live) and (rows == np.arange(len(live))).all() else s[rows]
            low, high = bounded(need[w])[:, None], bounded(hi[w])[:, None]
            fits = allowed[rows] & (own >= low) & (own <= high)
            if len(other) > k and fits.sum() > DENSE * k * len(w):  # raise the limits first, so that few scores are sorted
                least_held = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
                kth = np.partition(np.where(fits, own, least_held), len(other) - k, axis=1)[:, len(other) - k]
                fits &= own >= kth[:, None]
            q, c = np.nonzero(fits)
            kept.add(w[q], other[c], own[q, c].astype(np.int64), need)
    return wants, kept


_FOUND = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
_FOUND_DDL = "block long, place int, slot int, id long, score long"


def _cell(t: pa.Table, k: int, same: bool) -> pa.Table:
    """Every block of a group against the buckets of a chunk."""
    rows = t.to_pylist()
    buckets = sorted((r for r in rows if r["block"] is None), key=lambda r: -r["top"])
    for b in buckets:
        b["id"], b["label"] = np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64)
        b["x"] = _matrix(b["v"], b["length"], b["width"]) if b["length"] else np.zeros((len(b["id"]), 0), np.int32)
    out = []
    for r in rows:
        if r["block"] is not None and r["wants"]:
            wants, kept = _search_block(r, buckets, k, same)
            n = len(kept.at)
            out.append(pa.Table.from_arrays([pa.array(np.full(n, r["block"])), pa.array(wants["place"][kept.at].astype(np.int32)), pa.array(wants["slot"][kept.at].astype(np.int32)), pa.array(kept.ids), pa.array(kept.scores)], schema=_FOUND))
    return pa.concat_tables(out) if out else _FOUND.empty_table()


_WINDOW = ["block", "place", "slot"]


def search(anchors: DataFrame, windows: DataFrame, buckets: DataFrame, k: int, same: bool) -> DataFrame:
    """(block, place, slot, id, score, rank): the k best candidates of each window, of the anchor's own label or of others.

    windows (block, place, slot, norm, lo, hi): norm is the anchor's. anchors and buckets are _packed tables, and block is a
    number of an anchors' pack. Candidates of the anchor's vec_id are left out.
    """
    packs = anchors.select((F.col("part").cast("long") * (1 << 32) + F.col("seq")).alias("block"), "length", "width", "ids", "labels", "v", F.col("group").alias("h"))
    chunks = buckets.groupBy("length", F.col("group").alias("chunk")).agg(F.max("top").alias("top"))
    last = chunks.agg(F.max("chunk")).first()[0]
    best = None
    rounds = 0 if last is None else (last + 1).bit_length()
    for i in range(rounds):
        first, stop = (1 << i) - 1, (1 << (i + 1)) - 1
        left = windows.withColumn("need", F.col("lo"))
        if best is not None:
            held = best.groupBy(*_WINDOW).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
            left = windows.join(held, _WINDOW, "left").withColumn("need", F.when(F.col("n") == k, F.greatest("lo", "kth")).otherwise(F.col("lo")))
        reach = F.when(F.col("need") <= 0, F.lit(float("-inf"))).when(F.col("norm") == 0, F.lit(float("inf"))).otherwise(F.col("need") / F.col("norm"))
        wants = left.groupBy("block").agg(F.min(reach).alias("reach"), F.collect_list(F.struct("place", "slot", "need", "hi")).alias("wants"))
        ready = packs.join(wants, "block")
        near = chunks.where(F.col("chunk").between(first, stop - 1))
        pairs = ready.select("block", "h", "length", "reach").join(near, "length").where(F.col("top") * (1 + 1e-9) >= F.col("reach"))
        pairs = materialise(pairs.select("block", "h", "length", "chunk"), "pairs")
        cells = pairs.select("length", "chunk", "h").distinct()
        some = buckets.where(F.col("group").between(first, stop - 1)).withColumnRenamed("group", "chunk").join(cells, ["length", "chunk"])
        nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
        dealt = some.select("length", "chunk", "h", "width", "top", "ids", "labels", "v", nothing("block", "long"), nothing("wants", "array<struct<place:int,slot:int,need:bigint,hi:bigint>>"))
        dealt = dealt.unionByName(ready.drop("reach").join(pairs.select("block", "chunk"), "block").withColumn("top", F.lit(None).cast("double")))
        found = dealt.groupBy("length", "chunk", "h").applyInArrow(lambda t: _cell(t, k, same), _FOUND_DDL)
        best = found if best is None else best.drop("rank").unionByName(found)
        order = Window.partitionBy(*_WINDOW).orderBy(F.desc("score"), "id")
        best = materialise(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    return windows.sparkSession.createDataFrame([], _FOUND_DDL + ", rank int") if best is None else best


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of a pack."""
    for b in batches:
        for block, length, width, ids, v in zip(*(c.to_pylist() for c in b.columns)):
            own = np.frombuffer(ids, np.int64)
            x = (_matrix(v, length, width) if length else np.zeros((len(own), 0))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own), pa.array(np.sqrt((x * x).sum(1)))], names=["block", "place", "anchor_id", "norm"])


def _share(c: str, percent: int, up: bool) -> F.Column:
    """percent of a whole number, over 100, rounded up or down without leaving 64 bits."""
    rest = F.pmod(F.col(c), F.lit(100))
    whole = F.expr(f"({c} - pmod({c}, 100)) div 100") * percent
    return whole + (F.ceil(rest * percent / 100) if up else F.floor(rest * percent / 100))


def hard_negatives(vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors among vectors (vec_id, embedding, label, ...).

    A score is the inner product of two vectors whose components are floor(scale * x). An anchor's positives are its best rows
    of the same label; for each of them, the negatives are the best rows of other labels whose scores lie between low and high
    percent of the positive's. Ties go to the smaller vec_id. is_anchor and label are SQL over the columns of vectors.

    Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part, nor do vectors whose scaled
    norm is 2^31 or more, as scores would leave 64 bits. Vectors of different lengths are not compared; those without
    components score 0. Rows equal in vec_id, label and vector count once; rows that share an anchor's vec_id otherwise are
    anchors of their own, and neither its positives nor its negatives. A positive of a negative score has an empty window.
    Anchors without positives or negatives give no rows, and an empty table none. Further columns are not read but by the SQL.
    """
    spark = vectors.sparkSession
    with temporary_tables(spark) as keep:
        picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), "embedding", F.expr(is_anchor).alias("anchor"))
        usable = picked.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        rows = materialise(usable.select("vec_id", "label", "embedding").mapInArrow(lambda it: _scaled(it, scale), _ROW), "scaled")
        buckets = _packed(rows, BUCKET_BYTES, CHUNK_BYTES, "buckets")
        own = usable.where("anchor").select("vec_id", "label", "embedding").mapInArrow(lambda it: _scaled(it, scale), _ROW)
        anchors = _packed(materialise(own, "own"), BLOCK_BYTES, GROUP_BYTES, "anchors")
        block = (F.col("part").cast("long") * (1 << 32) + F.col("seq")).alias("block")
        members = materialise(anchors.select(block, "length", "width", "ids", "v").mapInArrow(_members, "block long, place int, anchor_id long, norm double"), "members")
        windows = members.select("block", "place", F.lit(0).alias("slot"), "norm", F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi"))
        found = search(anchors, windows, buckets, positives, True)
        chosen = found.drop("slot").join(members, ["block", "place"]).select("block", "place", F.col("rank").alias("slot"), "norm", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), _share("score", low, True).alias("lo"), _share("score", high, False).alias("hi"))
        chosen = materialise(chosen.where("lo <= hi"), "windows")
        worst = search(anchors, chosen.select("block", "place", "slot", "norm", "lo", "hi"), buckets, negatives, False)
        out = worst.join(chosen, _WINDOW).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return keep(materialise(out, "negatives"))
