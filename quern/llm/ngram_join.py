"""N-gram Jaccard join: a size-aware heavy-light set-similarity join over word shingles, exact at any size.

Method (size-aware join after Deng, Tao and Li, 2018, on prefixes in rarest-first order):

1. Each text becomes a set of shingle hashes. Equal sets are one node, so copies never meet each other again.
2. Shingles are dealt out by hash range, of about BUCKET each at most, as packed sorted runs. Each range counts in how many
   sets a shingle occurs; those of one set can't be in a link, and only the others go back to their sets, with that frequency.
   Shingles that runs show in many sets (hot_shingles) are dealt out by shingle and set instead, so that no range
   gathers all sets of one; they are common to all orders as the most frequent.
3. Rarest first, a set needs its first n - ceil(t n) + 1 shingles to share one with every partner, and one more to share
   two. Sets whose shared shingles are too few for any partner end here.
4. Small sets enumerate the 2-subsets of their prefix; pairs of small sets must share one. Pairs with a large set are
   found by scanning inverted lists of single shingles. The boundary between small and large is where the counted costs of
   both ways are least: the rows that sets of each size write, counted in full, and the pairs within the lists of either
   kind, counted in a sample of whole lists. A positional bound drops pairs that can't reach the threshold.
5. Lists of up to LIGHT sets give all their pairs. A heavier list first gives a star around its most typical set; after
   components are known, only its pairs between different components are left, and are made in blocks of at most BLOCK
   sets by BLOCK, so no list meets in one task and no group of near copies is multiplied out.
6. Each pair is verified by exact intersection, and components follow from the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm import text as T
from quern.llm.components import connected
from quern.session import materialise, partitions, temporary_tables

LIGHT, BLOCK, RUN, BUCKET, OFTEN, HOT, MOST_HOT, COSTED, MOST_TASKS = 32, 8192, 1 << 21, 1 << 21, 4, 1 << 18, 1 << 20, 1 << 20, 20_000
_U = np.uint64


def least_overlap(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest intersection that a set of n can have with any partner: ceil(t n)."""
    return (num * n + den - 1) // den


def _digest(s: np.ndarray) -> int:
    return int(np.sum(T.mix(s ^ _U(0xA5A5A5A55A5A5A5A)), dtype=np.uint64, keepdims=True).view(np.int64)[0])


_SETS = pa.schema([("n_shingles", pa.int64()), ("node", pa.int64()), ("often", pa.binary()), ("times", pa.binary())])


def _often(held: list[np.ndarray]) -> tuple[bytes, bytes]:
    """Shingles (48 bits) that OFTEN or more of the sets hold, and in how many."""
    h = np.sort(np.concatenate([*held, np.zeros(0, np.uint64)]) >> _U(16))
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(h)))
    return h[start[times >= OFTEN]].tobytes(), times[times >= OFTEN].astype(np.uint32).tobytes()


def _sets(batches: Iterator[pa.RecordBatch], k: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([pa.field("doc_id", kind), *_SETS])
    held: dict[int, np.ndarray] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        often, times = _often(list(held.values()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([None], kind), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([often]), pa.array([times])], schema=schema)

    for b in T.slices(batches, 1):
        n, node = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for row, s in T.shingle_sets(b.column(1), k):
            n[row], node[row] = len(s), _digest(s) if len(s) else 0
            if len(s) and node[row] not in held:
                held[node[row]] = s
                size += len(s)
        none = pa.nulls(b.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0).cast(kind), pa.array(n), pa.array(node), none, none], schema=schema)
        if size >= RUN:
            yield flush()
            size = 0
    if held:
        yield flush()


def shingle_nodes(docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, node) of each row, node being a 64-bit digest of the set, 0 where it is empty; and, for each
    run of about RUN shingles of different sets, the shingles that OFTEN or more of its sets hold (often, times). Both are
    one written table.
    """
    field = docs.schema["doc_id"].dataType
    kind = to_arrow_type(field)
    out = docs.select("doc_id", "text").mapInArrow(lambda it: _sets(it, k, kind), f"doc_id {field.simpleString()}, n_shingles long, node long, often binary, times binary")
    out = materialise(out, "sets")
    rows, often = out.where("n_shingles >= 0").select("doc_id", "n_shingles", "node"), out.where("n_shingles < 0").select("often", "times")
    rows._table_path = out._table_path
    return rows, often


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for often, times in zip(*(b.column(c).to_pylist() for c in (0, 1))):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(often, np.uint64).view(np.int64)), pa.array(np.frombuffer(times, np.uint32).astype(np.int64))], names=["h", "times"])


def hot_shingles(often: DataFrame, total: int) -> np.ndarray:
    """Sorted shingles that the runs show in HOT sets or more (in more than a MOST_HOT-th of the total, where that is over HOT).

    So there are MOST_HOT at most. A shingle left out is in under HOT + OFTEN * runs sets.
    """
    most = often.mapInArrow(_opened, "h long, times long").groupBy("h").agg(F.sum("times").alias("times")).where(F.col("times") >= max(HOT, total // MOST_HOT + 1))
    return np.sort(np.array([r["h"] for r in most.select("h").collect()], np.int64).view(np.uint64))


def _pack(h: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted 48-bit values as 32-bit steps; larger steps apart."""
    step = np.diff(h, prepend=_U(0))
    wide = step >= _U(0xFFFFFFFF)
    return np.where(wide, _U(0xFFFFFFFF), step).astype(np.uint32).tobytes(), step[wide].tobytes()


def _unpack(steps: bytes, wide: bytes) -> np.ndarray:
    s = np.frombuffer(steps, np.uint32).astype(np.uint64)
    s[s == _U(0xFFFFFFFF)] = np.frombuffer(wide, np.uint64)
    return np.cumsum(s, dtype=np.uint64)


def _bucket(h48: np.ndarray, n: int) -> np.ndarray:
    return ((h48 >> _U(16)) * _U(n) >> _U(32)).astype(np.int64)


def spread_names(spark: SparkSession, n: int, tasks: int) -> np.ndarray:
    """n numbers of which Spark deals the i-th to partition i % tasks, so that every partition has its equal part of them."""
    each = -(-n // tasks)
    width = tasks * (2 * each + int(np.log(tasks)) + 12)
    while True:
        found = spark.range(width).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(tasks)).alias("p")).agg(F.slice(F.sort_array(F.collect_list("x")), 1, each).alias("x"))
        names = {r["p"]: r["x"] for r in found.collect()}  # n numbers
        if len(names) == tasks and all(len(x) == each for x in names.values()):
            return np.array([names[i % tasks][i // tasks] for i in range(n)], np.int32)
        width *= 2


def _runs(batches: Iterator[pa.RecordBatch], k: int, n_buckets: int, hot: np.ndarray, n_hot: int, called: np.ndarray) -> Iterator[pa.RecordBatch]:
    nodes: dict[int, int] = {}
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        names = np.fromiter(nodes, np.int64, len(nodes))
        h = np.concatenate(held) >> _U(16)
        owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])
        bucket = _bucket(h, n_buckets)
        if len(hot):
            at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h)
            bucket[at] = n_buckets + ((T.mix(h[at] * _U(0x9E3779B97F4A7C15) ^ names[owner[at]].view(np.uint64)) >> _U(32)) * _U(n_hot) >> _U(32)).astype(np.int64)
            order = np.lexsort((h, bucket))
        else:
            order = np.argsort(h)
        h, owner, bucket = h[order], owner[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(n_buckets + n_hot + 1))
        rows: dict[str, list] = {"bucket": [], "hot": [], "names": [], "owner": [], "steps": [], "wide": []}
        for b in np.flatnonzero(np.diff(cut)):
            x, at = h[cut[b] : cut[b + 1]], owner[cut[b] : cut[b + 1]]
            used = np.zeros(len(names), bool)
            used[at] = True
            where = np.cumsum(used, dtype=np.int64) - 1
            steps, wide = _pack(x)
            for c, v in zip(rows, (int(called[b]), bool(b >= n_buckets), names[used].tobytes(), where[at].astype(np.uint16 if used.sum() < 65536 else np.uint32).tobytes(), steps, wide)):
                rows[c].append(v)
        nodes.clear()
        held.clear()
        return pa.RecordBatch.from_pydict(rows, schema=_RUN)

    size = 0
    for b in T.slices(batches, 0):
        for _, s in T.shingle_sets(b.column(0), k):
            if len(s) and (d := _digest(s)) not in nodes:
                nodes[d] = len(held)
                held.append(s)
                size += len(s)
                if size >= RUN:
                    yield flush()
                    size = 0
    if held:
        yield flush()


_RUN = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("names", pa.binary()), ("owner", pa.binary()), ("steps", pa.binary()), ("wide", pa.binary())])
_SHARED = pa.schema([("nb", pa.int32()), ("names", pa.binary()), ("runs", pa.binary()), ("high", pa.binary()), ("low", pa.binary()), ("freq", pa.binary())])


def _node_bucket(node: np.ndarray, n: int) -> np.ndarray:
    return ((T.mix(node.view(np.uint64).copy()) >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _released(t: pa.Table) -> pa.Table:
    """t, after the memory that its making took has gone back to the system."""
    T.release()
    return t


def _shared(t: pa.Table, n_buckets: int, called: np.ndarray) -> pa.Table:
    """One range of shingles: (set, shingle, frequency) for those of two sets or more, dealt out by set.

    Hot ranges hold parts of hot shingles, which all stay, with the highest frequency.
    """
    hot = t.column("hot")[0].as_py()
    hs, ns = [], []
    for names, owner, steps, wide in zip(*(t.column(c).to_pylist() for c in ("names", "owner", "steps", "wide"))):
        h = _unpack(steps, wide)
        hs.append(h)
        ns.append(np.frombuffer(names, np.int64)[np.frombuffer(owner, np.uint16 if len(owner) == 2 * len(h) else np.uint32)])
    h, node = np.concatenate(hs), np.concatenate(ns)
    del hs, ns
    order = np.argsort(h)
    h, node = h[order], node[order]
    if not hot:
        new = np.concatenate([[True], h[1:] != h[:-1]])
        multi = ~new
        multi[:-1] |= ~new[1:]
        h, node = h[multi], node[multi]
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    if len(h):  # the same set in two runs
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
        h, node = h[fresh], node[fresh]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        freq = np.diff(np.append(start, len(h)))
        freq = np.full(len(h), 65535) if hot else np.repeat(freq, freq)
        keep = freq > 1
        h, node, freq = h[keep], node[keep], freq[keep]
    if not len(h):
        return _SHARED.empty_table()
    nb = _node_bucket(node, n_buckets)
    order = np.lexsort((node, nb))
    h, node, freq, nb = h[order], node[order], np.minimum(freq[order], 65535).astype(np.uint16), nb[order]
    cut = np.searchsorted(nb, np.arange(n_buckets + 1))
    rows: dict[str, list] = {c: [] for c in _SHARED.names}
    for b in np.flatnonzero(np.diff(cut)):
        s = slice(cut[b], cut[b + 1])
        x = node[s]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        for c, v in zip(rows, (int(called[b]), x[first].tobytes(), np.diff(np.append(first, len(x))).astype(np.uint32).tobytes(), (h[s] >> _U(16)).astype(np.uint32).tobytes(), (h[s] & _U(0xFFFF)).astype(np.uint16).tobytes(), freq[s].tobytes())):
            rows[c].append(v)
    return pa.Table.from_pydict(rows, schema=_SHARED)


def _prefix(n: int, c: int, n1: int, held: int) -> tuple[int, int]:
    """How many of a set's shared shingles, rarest first, one that it must share is among, and two."""
    return min(max(0, n - c + 1 - n1), held), min(max(0, n - c + 2 - n1), held)


_NODE = pa.schema([("node", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("n1", pa.int64()), ("list_rows", pa.int64()), ("subset_rows", pa.int64()), ("items", pa.binary())])


def _assemble(shared: pa.Table, classes: pa.Table, num: int, den: int) -> pa.Table:
    """Sets with their shared shingles, rarest first; only those that share enough for some partner."""
    if not shared.num_rows or not classes.num_rows:
        return _NODE.empty_table()
    cols = {c: shared.column(c).to_pylist() for c in _SHARED.names[1:]}
    node = np.concatenate([np.repeat(np.frombuffer(a, np.int64), np.frombuffer(r, np.uint32)) for a, r in zip(cols["names"], cols["runs"])])
    h = np.concatenate([(np.frombuffer(a, np.uint32).astype(np.uint64) << _U(16)) | np.frombuffer(b, np.uint16) for a, b in zip(cols["high"], cols["low"])])
    freq = np.concatenate([np.frombuffer(a, np.uint16) for a in cols["freq"]]).astype(np.int64)
    order = np.lexsort((h, freq, node))
    node, h, freq = node[order], h[order], freq[order]
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    stop = np.append(start[1:], len(node))
    known, n_of, rep_of = (classes.column(c).to_numpy() for c in ("node", "n", "rep"))
    sort = np.argsort(known)
    at = sort[np.searchsorted(known[sort], node[start])]
    n, rep = n_of[at], rep_of[at]
    rows: dict[str, list] = {c: [] for c in _NODE.names}
    c = least_overlap(n, num, den)
    for i in np.flatnonzero((stop - start >= c) & (c >= 2)):
        n1 = int(n[i]) - int(stop[i] - start[i])
        q, q2 = _prefix(int(n[i]), int(c[i]), n1, int(stop[i] - start[i]))
        for k, v in zip(rows, (int(node[start[i]]), int(rep[i]), int(n[i]), n1, q, q2 * (q2 - 1) // 2, h[start[i] : stop[i]].tobytes())):
            rows[k].append(v)
    return pa.Table.from_pydict(rows, schema=_NODE)


def boundary(costs: list[tuple[int, float, float, float, float]], num: int = 80, den: int = 100) -> int:
    """The size from which sets are large.

    costs: of a class of sizes each, the size, the rows of lists and of subsets that its sets write, and the pairs in lists
    and in subsets' lists whose larger set is in the class. Sets below the boundary write subsets, and list rows too where a
    large partner is possible; larger sets write list rows. Pairs of small sets come from subsets, others from lists.
    """
    costs = sorted(costs)
    best, at = None, 0
    for x in [0, *(c[0] for c in costs), 1 << 60]:
        cost = sum(c[2] + c[4] if c[0] < x else c[3] for c in costs) + sum(c[1] for c in costs if c[0] * den >= x * num)
        if best is None or cost < best:
            best, at = cost, x
    return at


def _subset_keys(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all 2-subsets (marked by bit 62), and the place of each one's later shingle."""
    i, j = np.triu_indices(len(h), 1)
    return ((T.mix(h[i] * _U(0x9E3779B97F4A7C15) + h[j]) >> _U(2)) | _U(1 << 62)).view(np.int64), j


def _sampled(batches: Iterator[pa.RecordBatch], rate: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(key, node, n) of list rows of either kind whose key falls in the sample.

    Where over LIGHT + 2 shingles are to be paired, subsets are left out: their rows alone cost more than all lists could.
    """
    for b in batches:
        keys, node, n = [], [], []
        for name, size, n1, items in zip(*(b.column(c).to_pylist() for c in ("node", "n", "n1", "items"))):
            h = np.frombuffer(items, np.uint64)
            q, q2 = _prefix(size, (num * size + den - 1) // den, n1, len(h))
            k = np.concatenate([h[:q].view(np.int64), *([_subset_keys(h[:q2])[0]] if q2 <= LIGHT + 2 else [])])
            k = k[T.mix(k.view(np.uint64).copy()) % _U(rate) == 0]
            keys.append(k)
            node.append(np.full(len(k), name, np.int64))
            n.append(np.full(len(k), size, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*a, np.zeros(0, np.int64)])) for a in (keys, node, n)], names=["key", "node", "n"])


def costs(nodes: DataFrame, num: int, den: int) -> list[tuple[int, float, float, float, float]]:
    """What boundary weighs, of sets in classes of similar sizes: pairs are counted in whole lists, of about COSTED rows.

    A list of over LIGHT sets counts LIGHT / 2 pairs a set. The result of the join doesn't depend on these figures.
    """
    size = F.floor(F.log(1.1, F.col("n")))
    few = F.when(F.col("subset_rows") <= (LIGHT + 2) * (LIGHT + 1) // 2, F.col("subset_rows")).otherwise(0)
    rows = nodes.groupBy(size.alias("size")).agg(F.min("n").alias("s"), F.sum("list_rows").alias("lists"), F.sum("subset_rows").alias("subsets"), F.sum(few).alias("few")).collect()
    rate = max(1, sum(r["lists"] + r["few"] for r in rows) // COSTED)
    sample = nodes.select("node", "n", "n1", "items").mapInArrow(lambda it: _sampled(it, rate, num, den), "key long, node long, n long")
    sample = materialise(sample, "sample")
    met = materialise(sample.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "sample")
    met = sample.join(met, "key").select("key", "c", "node", "n", size.alias("size"))
    light, heavy = met.where(F.col("c") <= LIGHT), met.where(F.col("c") > LIGHT)
    a, b = light.select("key", F.col("node").alias("a"), F.col("n").alias("a_n")), light.select("key", "size", F.col("node").alias("b"), F.col("n").alias("b_n"))
    pairs = a.join(b, "key").where(f"struct(a_n, a) < struct(b_n, b) AND a_n * {den} >= b_n * {num}").select("key", "size", F.lit(1.0).alias("w"))
    pairs = pairs.unionByName(heavy.select("key", "size", F.lit(LIGHT / 2).alias("w")))
    got = pairs.groupBy("size", (F.col("key") >= 1 << 62).alias("two")).agg(F.sum("w").alias("w")).collect()
    of = {(r["size"], r["two"]): r["w"] * rate for r in got}
    return [(r["s"], r["lists"], r["subsets"], of.get((r["size"], False), 0.0), of.get((r["size"], True), 0.0)) for r in rows]


_SIGN = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("n1", pa.int64()), ("seen", pa.int64())])


def _signatures(batches: Iterator[pa.RecordBatch], x: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows of inverted lists: single shingles, and 2-subsets of small sets (marked by bit 62 of the key)."""
    for b in batches:
        out: list[list[np.ndarray]] = []
        for node, n, n1, items in zip(*(b.column(c).to_pylist() for c in ("node", "n", "n1", "items"))):
            h = np.frombuffer(items, np.uint64)
            q, q2 = _prefix(n, (num * n + den - 1) // den, n1, len(h))
            if n * den >= x * num:
                out.append([h[:q].view(np.int64), np.arange(1, q + 1) + n1, np.ones(q, np.int64), (node, n, n1)])
            if n < x:
                key, j = _subset_keys(h[:q2])
                out.append([key, j + 1 + n1, np.full(len(j), 2), (node, n, n1)])
            if sum(len(o[0]) for o in out[-64:]) > 1 << 16 or len(out) > 4096:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


def _rows(out: list) -> pa.RecordBatch:
    m = [len(o[0]) for o in out]
    same = [np.repeat(np.array([o[3][i] for o in out], np.int64), m) for i in range(3)]
    key, pos, seen = (np.concatenate([o[i] for o in out]) for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(a) for a in (key, same[0], same[1], pos, same[2], seen)], schema=_SIGN)


def _possible(num: int, den: int, x: int) -> str:
    """Rows a and b of one list may still reach the threshold, by size and by position, and belong to this kind of list."""
    need = f"({num} * (a_n + b_n) + {num + den} - 1) div {num + den}"
    return f"a_seen + least(a_n - a_pos, b_n - b_pos) >= {need} AND (a_seen = 2 OR greatest(a_n, b_n) >= {x})"


def _sided(df: DataFrame, side: str, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "pos", "seen")))


def _overlaps(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a_n, b_n = (b.column(c).to_numpy() for c in ("a_n", "b_n"))
        same = np.fromiter((len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(b.column("a_items").to_pylist(), b.column("b_items").to_pylist())), np.int64, b.num_rows)
        ok = pa.array(den * same >= num * (a_n + b_n - same))
        yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in ("a", "b")], names=["a", "b"])


def _verified(pairs: DataFrame, nodes: DataFrame, num: int, den: int, name: str = "rep", parts: int = 1) -> DataFrame:
    """pairs (a_node, b_node) -> links (a, b) between both sets, by default as their smallest doc_ids.

    With several parts, the pairs of one set are dealt out over so many, each with its own copy of the set's shingles.
    """
    side = lambda s: nodes.select(*(F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "items")), F.col(name).alias(s))
    if parts > 1:
        part = lambda s: F.pmod(F.xxhash64(f"{s}_node"), F.lit(parts)).cast("int")
        pairs = materialise(pairs.withColumns({"a_part": part("b"), "b_part": part("a")}), "pairs")
        a, b = (pairs.select(f"{s}_node", f"{s}_part").distinct().join(side(s), f"{s}_node") for s in "ab")
        j = pairs.join(a, ["a_node", "a_part"]).join(b, ["b_node", "b_part"])
    else:
        j = pairs.join(side("a"), "a_node").join(side("b"), "b_node")
    return j.select("a", "b", "a_n", "b_n", "a_items", "b_items").mapInArrow(lambda it: _overlaps(it, num, den), "a long, b long")


def _pairs_in_blocks(rows: DataFrame, x: int, num: int, den: int) -> DataFrame:
    """Pairs between different components of heavy lists, dealt out as pairs of blocks of each list."""
    rows = rows.withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("long")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    left = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    left = left.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    a = left.select("key", "i", "j", F.col("block").alias("a_block"), F.col("comp").alias("a_comp"), *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "pos", "seen")))
    b = left.select("key", "i", "j", F.col("block").alias("b_block"), F.col("comp").alias("b_comp"), *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "pos", "seen")))
    j = a.join(b, ["key", "i", "j"]).where("a_comp <> b_comp AND a_node < b_node").where(_possible(num, den, x))
    return j.where("(i = j) OR (a_block <> b_block)").select("a_node", "b_node").distinct()


def _lists(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, int, DataFrame]:
    """Rows with their sets, classes of equal sets, their shared shingles, the boundary, and the inverted lists."""
    spark = docs.sparkSession
    rows, often = shingle_nodes(docs, k)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    hot = hot_shingles(often, total)
    parts = max(partitions(spark), -(-total // BUCKET))
    n_hot = parts if len(hot) else 0
    held = spark.sparkContext.broadcast(hot)  # at most MOST_HOT numbers
    tasks = min(parts, MOST_TASKS)
    called = spark.sparkContext.broadcast(spread_names(spark, 2 * parts, tasks))  # two numbers a range
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").cast("long").alias("rep"), F.first("n_shingles").alias("n"))
    bucketed = classes.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array(called.value[_node_bucket(b.column(0).to_numpy(), parts)]), *b.columns], names=["nb", "node", "rep", "n"]) for b in it), "nb int, node long, rep long, n long")
    runs = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(lambda it: _runs(it, k, parts, held.value, n_hot, called.value), "bucket int, hot boolean, names binary, owner binary, steps binary, wide binary")
    # a task for each range (or MOST_TASKS, each for its equal part), so that what one task reads hardly grows with the input
    shared = runs.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda t: _released(_shared(t, parts, called.value)), "nb int, names binary, runs binary, high binary, low binary, freq binary")
    nodes = shared.repartition(tasks, "nb").groupBy("nb").cogroup(bucketed.repartition(tasks, "nb").groupBy("nb")).applyInArrow(lambda s, c: _released(_assemble(s, c, num, den)), "node long, rep long, n long, n1 long, list_rows long, subset_rows long, items binary")
    nodes = materialise(nodes, "nodes")
    x = boundary(costs(nodes, num, den), num, den)
    signs = nodes.select("node", "n", "n1", "items").mapInArrow(lambda it: _signatures(it, x, num, den), "key long, node long, n long, pos long, n1 long, seen long")
    signs = materialise(signs.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(partitions(spark))).cast("int")), "lists")
    keys = signs.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("n1", "n", "node", "pos", "seen")).alias("hub"))
    keys = keys.groupBy("key").agg(F.sum("c").alias("c"), F.min("hub").alias("hub"), F.collect_set("part").alias("parts")).where("c > 1")
    lists = materialise(signs.join(keys.select("key", "c", "hub", F.explode("parts").alias("part")), ["key", "part"]), "lists")
    return rows, classes, nodes, x, lists


def _light_pairs(lists: DataFrame, x: int, num: int, den: int) -> DataFrame:
    light = lists.where(F.col("c") <= LIGHT)
    return _sided(light, "a", "key").join(_sided(light, "b", "key"), "key").where("a_node < b_node").where(_possible(num, den, x)).select("a_node", "b_node")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text, ...): links join documents whose sets of
    k-word shingles have den * intersection >= num * union.

    Null and empty texts have no set and stand alone; rows with a null doc_id stand alone with a null component. Rows that
    repeat a doc_id count as one document: they share its component. An empty table gives an empty result; further
    columns of docs are not read. doc_id is an integer column.
    """
    parts = partitions(docs.sparkSession)
    with temporary_tables(docs.sparkSession) as keep:
        rows, classes, nodes, x, lists = _lists(docs, k, num, den)
        pairs = _light_pairs(lists, x, num, den)
        heavy = lists.where(F.col("c") > LIGHT)
        star = heavy.where("node <> hub.node").select(F.least("node", "hub.node").alias("a_node"), F.greatest("node", "hub.node").alias("b_node"))
        links = _verified(pairs.distinct(), nodes, num, den).unionByName(_verified(star.distinct(), nodes, num, den, parts=parts))
        links = materialise(links, "verified")
        comps = materialise(connected(links), "components")
        held = heavy.join(nodes.select("node", "rep"), "node").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        held = materialise(held.select("key", "part", "c", "node", "n", "pos", "seen", "comp"), "heavy")
        split = held.groupBy("key", "part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        split = split.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_set("part").alias("parts")).where("lo <> hi")
        rest = materialise(held.join(split.select("key", F.explode("parts").alias("part")), ["key", "part"], "left_semi").drop("part"), "rest")
        if rest.take(1):
            more = materialise(_verified(_pairs_in_blocks(rest, x, num, den), nodes, num, den, parts=parts), "verified")
            comps = materialise(connected(links.unionByName(more)), "components")
        named = classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
        named = keep(materialise(named, "classes"))  # read anew, so that the join can be split where one set has very many copies
        keep(rows)
    return rows.join(named, (rows.node == named.node) & (rows.n_shingles > 0) & rows.doc_id.isNotNull(), "left").select("doc_id", "n_shingles", F.coalesce("component", F.col("doc_id").cast("long")).alias("component_id"))


def jaccard_link_counts(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, n_links) of every row of docs: the number of other documents whose set is linked with the row's.

    All candidate pairs are verified, those of heavy lists in blocks, so the cost grows with the number of links between
    different sets; equal sets are counted without pairs. Rows that repeat a doc_id and a set count as one document, and
    under another set as another one. Rows without a set or with a null doc_id have no links.
    """
    rows, classes, nodes, x, lists = _lists(docs, k, num, den)
    heavy = _pairs_in_blocks(lists.where(F.col("c") > LIGHT).withColumn("comp", F.col("node")), x, num, den)
    links = materialise(_verified(_light_pairs(lists, x, num, den).unionByName(heavy).distinct(), nodes, num, den, "node", partitions(docs.sparkSession)), "verified")
    held = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").select("node", "doc_id").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    held = materialise(held, "classes")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(held.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("near"))
    counts = held.join(near, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    counts = materialise(counts, "counts")
    return rows.join(counts, (rows.node == counts.node) & (rows.n_shingles > 0) & rows.doc_id.isNotNull(), "left").select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def deduplicate(docs: DataFrame, **options: int) -> DataFrame:
    """docs without those that have an equal or similar document with a smaller doc_id; one row of each group stays.

    Of rows that repeat the doc_id that stays, the one whose text has the least hash. Rows with a null doc_id stay, and so do
    those without a set, once for each doc_id. An empty table gives an empty result; the columns are those of docs.
    """
    with temporary_tables(docs.sparkSession) as keep:
        found = jaccard_components(docs, **options).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("n"))
        found = keep(materialise(found.where("c < doc_id OR n > 1"), "gone"))
    kept = docs.join(found.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    twice = found.where("c >= doc_id").select("doc_id")
    if not twice.take(1):
        return kept
    rows = docs.join(twice, "doc_id", "left_semi").select("doc_id", F.struct(*docs.columns).alias("row"), F.struct(F.xxhash64("text"), "text").alias("by"))
    return kept.unionByName(rows.groupBy("doc_id").agg(F.min_by("row", "by").alias("row")).select("row.*"))
