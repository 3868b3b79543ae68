"""Embedding near-duplicates by a pivot-permutation index.

1. Equal vectors are one node with a multiplicity, so copies are never compared.
2. Reference points are taken from the vectors of least hash (a bounded sample), leaving out any closer than APART to one
   taken before, so a group of near copies gives one. Each vector is described by its NEAR nearest pivots in order. Every
   vector is indexed, in the inverted lists of its pivots of least number, all but k - 1 where k is the number to be shared:
   the smallest of k shared pivots is always among these.
3. Lists hold descriptions alone, never vectors. A list is counted in tiles: bitmaps of two descriptions bound the number of
   pivots that they share, and pairs that pass are counted exactly. Two vectors are candidates if they share k pivots or
   more; they are looked at in the list of the smallest pivot they share, and so once.
4. A tile hands on its candidates as a matrix of bits over the vectors in it, to which these are joined once each; they are
   verified there by cosine in double precision. Links are counted in place; what leaves a task is each vector's number of
   links and a star forest of the tile's links, so a group of near copies costs its comparisons but no rows for its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import connected
from quern.session import materialise, temporary_tables

NEAR, BLOCK, TILE, BITS, MOST_PIVOTS, PIVOT_BYTES, SCORES, COSINE, APART = 16, 1 << 17, 1024, 256, 1 << 16, 64 << 20, 1 << 22, 0.9, 0.7


def n_pivots(n: int) -> int:
    """Grows with the root of the rows, so lists grow no faster than that: 64 at least, MOST_PIVOTS (for 10^9 rows) at most."""
    return int(min(MOST_PIVOTS, max(64, 2 * n**0.5)))


def n_shared(pivots: int) -> int:
    """How many of NEAR pivots vectors must share: fewer where there are more pivots, as near ones then differ more often.

    Of pairs of cosine 0.9 to 0.91 in 64 dimensions 0.98 and more share so many, from 64 to 40,000 pivots; in more dimensions
    it is no fewer.
    """
    return int(min(7, max(3, 10.2 - 0.42 * math.log2(max(1, pivots)))))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors, scaled to length 1 in double precision."""
    for b in batches:
        b = b.filter(pc.is_valid(b.column(1)))
        n = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        stop, full = np.cumsum(n), np.flatnonzero(n)
        ok = np.zeros(len(n), bool)
        if len(full):
            begin = (stop - n)[full]
            with np.errstate(all="ignore"):
                x = x / np.repeat(np.maximum.reduceat(np.abs(x), begin), n[full])
                x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, begin)), n[full])
                ok[full] = np.isfinite(np.add.reduceat(x, begin))
        rows = np.flatnonzero(ok)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([x[stop[i] - n[i] : stop[i]].tobytes() for i in rows], pa.binary())], names=["vec_id", "v"])


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to most rows of the sample, in its order, no two with a cosine over APART."""
    taken, n = np.zeros((min(most, len(sample)), sample.shape[1])), 0
    for x in sample:
        if n < len(taken) and (taken[:n] @ x <= APART).all():
            taken[n] = x
            n += 1
    return taken[:n]


_ENTRY = "length int, pivot int, node long, near binary"


def _described(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], near: int, least: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw = b.column(2).to_pylist()
        of: dict[int, list[int]] = {}
        for i, x in enumerate(raw):
            of.setdefault(len(x), []).append(i)
        for length, at in of.items():
            own = pivots[length]
            step = max(1, min(512, SCORES // len(own)))
            for c in range(0, len(at), step):
                rows = at[c : c + step]
                s = np.frombuffer(b"".join(raw[i] for i in rows), np.float64).reshape(len(rows), -1) @ own.T
                k = min(near, s.shape[1])
                top = np.sort(np.argpartition(-s, k - 1, axis=1)[:, :k], axis=1).astype(np.uint16)
                m = k - least[length] + 1
                packed = [t.tobytes() for t in top]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows) * m, length, np.int32)), pa.array(top[:, :m].ravel().astype(np.int32)), b.column(0).take(pa.array(np.repeat(np.array(rows), m))), pa.array([x for x in packed for _ in range(m)], pa.binary())], names=["length", "pivot", "node", "near"])


def _bitmaps(near: np.ndarray) -> np.ndarray:
    """A bit for each pivot number modulo BITS: two descriptions share no more pivots than bits, but for those that meet."""
    out = np.zeros((len(near), BITS // 64), np.uint64)
    at = near.astype(np.int64) % BITS
    for k in range(near.shape[1]):
        out[np.arange(len(near)), at[:, k] // 64] |= np.uint64(1) << (at[:, k] % 64).astype(np.uint64)
    return out


_CANDIDATES = "length int, left binary, right binary, bits binary"


def _counting(least_of: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of a pair of blocks of one list, a tile at a time."""
        t = pa.Table.from_batches(list(batches))
        length, key, i, j = (t.column(c)[0].as_py() for c in ("length", "pivot", "i", "j"))
        least = least_of[length]
        block, node = t.column("block").to_numpy(), t.column("node").to_numpy()
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.uint16).reshape(len(node), -1)
        maps = _bitmaps(near)
        slack = (near.shape[1] - np.bitwise_count(maps).sum(1)).astype(np.uint8)  # pivots of a description that meet in a bit hide behind each other
        sides = [np.flatnonzero(block == i), np.flatnonzero(block == j)]
        for p in range(0, len(sides[0]), TILE):
            a = sides[0][p : p + TILE]
            for q in range(p if i == j else 0, len(sides[1]), TILE):
                b = sides[1][q : q + TILE]
                common = np.zeros((len(a), len(b)), np.uint8)
                for w in range(maps.shape[1]):
                    common += np.bitwise_count(maps[a, w][:, None] & maps[b, w])
                rows, cols = np.nonzero(common + np.minimum(slack[a][:, None], slack[b]) >= least)
                if i == j and p == q:
                    keep = rows < cols
                    rows, cols = rows[keep], cols[keep]
                found = np.zeros((len(a), len(b)), bool)
                for c in range(0, len(rows), 1 << 16):
                    r, s = rows[c : c + (1 << 16)], cols[c : c + (1 << 16)]
                    x, y = near[a[r]], near[b[s]]
                    has = (x[:, :, None] == y[:, None, :]).any(2)
                    first = x[np.arange(len(x)), has.argmax(1)]  # the smallest one shared: descriptions are sorted
                    found[r, s] = (has.sum(1) >= least) & (first == key)
                left, right = np.flatnonzero(found.any(1)), np.flatnonzero(found.any(0))
                if len(left):
                    bits = np.packbits(found[np.ix_(left, right)]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([node[a[left]].tobytes()], pa.binary()), pa.array([node[b[right]].tobytes()], pa.binary()), pa.array([bits], pa.binary())], names=["length", "left", "right", "bits"])

    counted.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # the form of applyInArrow follows these
    return counted


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors that a tile needs, each once for either side."""
    for b in batches:
        for tile, left, right in zip(*(b.column(c).to_pylist() for c in ("tile", "left", "right"))):
            nodes = np.unique(np.concatenate([np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), tile)), pa.array(nodes)], names=["tile", "node"])


_FOUND = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("n", pa.int64())])


def _verifying(least: float) -> Callable[[pa.Table], pa.Table]:
    def verified(t: pa.Table) -> pa.Table:
        """One tile: numbers of links by vector (other null), and a star forest of links."""
        given = [r for r in t.select(["left", "right", "bits"]).filter(pc.is_valid(t.column("bits"))).to_pylist()]
        if not given:
            return _FOUND.empty_table()
        t = t.filter(pc.is_valid(t.column("node")))
        node, weight = t.column("node").to_numpy(), t.column("weight").to_numpy()
        order = np.argsort(node)
        node, weight = node[order], weight[order]
        raw = t.column("v").to_pylist()
        x = np.frombuffer(b"".join(raw[k] for k in order), np.float64).reshape(len(node), -1)
        a, b = (np.searchsorted(node, np.frombuffer(given[0][c], np.int64)) for c in ("left", "right"))
        bits = np.unpackbits(np.frombuffer(given[0]["bits"], np.uint8), count=len(a) * len(b)).reshape(len(a), len(b)).astype(bool)
        link = bits & (x[a] @ x[b].T >= least)
        count = np.zeros(len(node), np.int64)
        np.add.at(count, a, link @ weight[b])
        np.add.at(count, b, weight[a] @ link)
        stars: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def find(p: int) -> int:
            while root.get(p, p) != p:
                p = root[p]
            return p

        for p, q in zip(*np.nonzero(link)) if link.sum() < 4 * len(node) else _forest(link):
            u, v = find(int(a[p])), find(int(b[q]))
            if u != v:
                root[max(u, v)] = min(u, v)
                stars.append((int(node[a[p]]), int(node[b[q]])))
        live = np.flatnonzero(count)
        return pa.Table.from_arrays([pa.array(np.concatenate([node[live], np.array([s[0] for s in stars], np.int64)])), pa.array([None] * len(live) + [s[1] for s in stars], pa.int64()), pa.array(np.concatenate([count[live], np.zeros(len(stars), np.int64)]))], schema=_FOUND)

    return verified


def _batches(lengths: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """(bytes of a vector, number of vectors) in batches whose pivots take PIVOT_BYTES at most (or one length's, if that is more)."""
    out, size = [], 0
    for length, n in lengths:
        more = n_pivots(n) * length
        if out and size + more > PIVOT_BYTES:
            yield out
            out, size = [], 0
        out.append((length, n))
        size += more
    if out:
        yield out


def _sample(own: DataFrame, lengths: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """For each length the vectors of least hash, twice as many as pivots are wanted (a few more are read), in hash order."""
    quota = {length: 2 * n_pivots(n) for length, n in lengths}
    share = F.create_map(*(F.lit(x) for length, n in lengths for x in (length, min(1.0, (quota[length] + 6 * quota[length] ** 0.5) / n))))
    place = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    got = own.where(place / float(1 << 30) < share[F.length("v")]).select(place.alias("place"), "v").toArrow()
    rows = sorted(zip(got.column("place").to_pylist(), got.column("v").to_pylist()))
    out: dict[int, list[bytes]] = {}
    for _, v in rows:
        if len(held := out.setdefault(len(v), [])) < quota[len(v)]:
            held.append(v)
    return {length: np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1) for length, x in out.items()}


def _forest(link: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join whatever the matrix of links joins: breadth first, each row and column reached once."""
    rows, cols = np.ones(link.shape[0], bool), np.ones(link.shape[1], bool)
    for start in range(link.shape[0]):
        queue = [(start, True)] if rows[start] else []
        rows[start] = False
        while queue:
            p, is_row = queue.pop()
            new = np.flatnonzero((link[p] & cols) if is_row else (link[:, p] & rows))
            (cols if is_row else rows)[new] = False
            for q in new:
                yield (p, int(q)) if is_row else (int(q), p)
                queue.append((int(q), not is_row))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, near: int = NEAR, shared: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, ...).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; others link within their
    length only. Rows that repeat a vector link with each other whatever their vec_id; a null vec_id is left out of links, and
    its component is null. An empty table gives an empty result; further columns are not read.
    """
    spark = vectors.sparkSession
    with temporary_tables(spark) as keep:
        return keep(materialise(_near_duplicates(vectors, cosine, near, shared), "near_duplicates"))


def _links(own: DataFrame, lengths: list[tuple[int, int]], cosine: float, near: int, shared: int | None) -> DataFrame:
    """(node, other, n) of the nodes of some lengths: numbers of links (other null), and links that join what is linked."""
    spark = own.sparkSession
    pivots = {length: spread(x, n_pivots(n)) for (length, n), (_, x) in zip(lengths, sorted(_sample(own, lengths).items()))}
    held = spark.sparkContext.broadcast(pivots)  # PIVOT_BYTES at most, or MOST_PIVOTS vectors
    least = {length: min(len(x), near, shared or n_shared(len(x))) for length, x in pivots.items()}
    entries = materialise(own.mapInArrow(lambda it: _described(it, held.value, near, least), _ENTRY), "index")
    of_list = entries.groupBy("length", "pivot").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("length", "pivot", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(of_list, ["length", "pivot"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    tiles = materialise(dealt.groupBy("length", "pivot", "i", "j").applyInArrow(_counting(least), _CANDIDATES).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    needed = tiles.select("tile", "left", "right").mapInArrow(_members, "tile long, node long")
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    rows = needed.join(own, "node").select("tile", "node", "weight", "v", *(nothing(c, "binary") for c in ("left", "right", "bits")))
    rows = rows.unionByName(tiles.select("tile", nothing("node", "long"), nothing("weight", "long"), nothing("v", "binary"), "left", "right", "bits"))
    return materialise(rows.groupBy("tile").applyInArrow(_verifying(cosine), "node long, other long, n long"), "found")


def _near_duplicates(vectors: DataFrame, cosine: float, near: int, shared: int | None) -> DataFrame:
    usable = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_usable, "vec_id long, v binary")
    usable = materialise(usable, "vectors")
    classes = usable.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    classes = materialise(classes.select("node", "weight", "v"), "classes")
    lengths = [tuple(r) for r in classes.groupBy(F.length("v").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()]
    found = None
    for batch in _batches(lengths):
        part = _links(classes.where(F.length("v").between(batch[0][0], batch[-1][0])), batch, cosine, near, shared)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    comps = connected(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = classes.join(counts, "node", "left").join(comps, "node", "left")
    named = named.select("v", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    named = usable.join(named, "v").groupBy("vec_id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    out = vectors.select("vec_id").join(named.withColumnRenamed("vec_id", "__id"), F.col("vec_id") == F.col("__id"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", F.col("vec_id").cast("long")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
