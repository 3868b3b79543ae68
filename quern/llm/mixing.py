"""Mixing sources to target weights by Pfair scheduling (Baruah, Cohen, Plaxton and Varvel, 1996).

Documents of a source form blocks of BLOCK. In the ideal mix all sources flow at once at the rates of their exact weights,
and one that runs dry leaves its share to the rest. Block j of a source may start in the slot in which the ideal mix begins
it and must be placed by the slot in which the ideal mix ends it; while none is dry these are slots floor(j / w) and
ceil((j + 1) / w). Earliest-deadline-first over the released blocks meets every deadline, as the ideal mix is a fractional
solution, so after any number of slots each source is less than one block from its share. The driver schedules number by
number, CHUNK slots at a time in bounded memory, and every block finds its slot by a join.

Blocks are numbered without gathering a source: its documents are dealt into hash slices of about SLICE rows, ranked
within their slice, and the slices' sizes are summed.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.groups import join_groups
from quern.session import materialise, own_dir, ranges, temporary_tables, written_table

BLOCK, SLICE, FRAME, ALPHA, CHUNK, TIES, EPS = 8, 2048, 1024, 0.7, 1 << 18, 4096, 1e-6


def shares(weights: Mapping[object, float], frame: int = FRAME) -> dict[object, int]:
    """Whole slots of a frame for each source, one at least, by largest remainder."""
    live = {k: float(v) for k, v in weights.items() if v and v > 0}
    if not live:
        return {}
    frame = max(frame, 4 * len(live))
    total = sum(live.values())
    exact = {k: v / total * (frame - len(live)) for k, v in live.items()}
    out = {k: 1 + int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))[: frame - sum(out.values())]:
        out[k] += 1
    return out


def interleave(blocks: Sequence[int], weights: Sequence[float], chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """The source number of every slot in turn, until all blocks are placed: earliest deadline first among released blocks.

    Ties go to the block that the ideal mix ends first, then to the smaller number. Weights are positive numbers of any sum; bounds hold to within rounding of doubles.
    """
    b, w = np.asarray(blocks, np.int64), np.asarray(weights, np.float64)
    w = w / w.sum()
    dry = np.argsort(b / w, kind="stable")
    # the ideal mix has passed through slot at[i] when the source that runs dry i-th does so, at its own pace[i]
    pace = np.concatenate([[0.0], (b / w)[dry]])
    at = np.concatenate([[0.0], np.cumsum(np.cumsum(w[dry][::-1])[::-1] * np.diff(pace))])
    ready: list[int] = []
    begun, placed, end, total = np.zeros(len(b), np.int64), 0, 0, int(b.sum())
    while placed < total:
        end = min(end + chunk, total)
        upto = b if end == total else np.maximum(begun, np.minimum(b, np.ceil(w * np.interp(end, at, pace)).astype(np.int64)))
        n = upto - begun
        k = np.repeat(np.arange(len(b)), n)
        j = np.arange(len(k)) - np.repeat(np.cumsum(n) - n - begun, n)
        begun = upto
        release = np.floor(np.interp(j / w[k], pace, at) + EPS)
        stop = np.interp((j + 1) / w[k], pace, at)
        deadline = np.ceil(stop - EPS)
        rank = deadline.astype(np.int64) * TIES - ((deadline - stop) * (TIES - 1)).astype(np.int64)
        order = np.argsort(release, kind="stable")
        entries, release = (rank * len(b) + k)[order].tolist(), release[order].tolist()
        i, out = 0, []
        for slot in range(placed, end):
            while i < len(entries) and (release[i] <= slot or not ready):
                heapq.heappush(ready, entries[i])
                i += 1
            if not ready:
                break
            out.append(heapq.heappop(ready) % len(b))
        for x in entries[i:]:
            heapq.heappush(ready, x)
        placed += len(out)
        yield np.array(out, np.int64)


def schedule(slots: Mapping[object, int]) -> list[tuple[object, int]]:
    """(source, block) in slot order of a frame with so many slots for each source."""
    names, seen, out = sorted(slots, key=str), dict.fromkeys(slots, 0), []
    for part in interleave([slots[k] for k in names], [slots[k] for k in names]):
        for k in (names[x] for x in part):
            out.append((k, seen[k]))
            seen[k] += 1
    return out


def _plan(spark: SparkSession, numbers: list[int], counts: list[int], weights: list[float], block: int) -> DataFrame:
    """(p_number, p_block, p_slot, p_start) of every block: its slot, and the documents before it in the mixed order."""
    kind = "p_number long, p_block long, p_slot long, p_start long"
    path = f"{own_dir(spark)}/plan-{uuid.uuid4().hex}"
    spark.createDataFrame([], kind).write.parquet(path)
    number, n = np.array(numbers, np.int64), np.array(counts, np.int64)
    seen, slot, start = np.zeros(len(n), np.int64), 0, 0
    for k in interleave(-(-n // block), weights):
        order = np.argsort(k, kind="stable")
        times = np.bincount(k, minlength=len(n))
        j = np.empty(len(k), np.int64)
        j[order] = np.arange(len(k)) - np.repeat(np.cumsum(times) - times - seen, times)
        size = np.minimum(block, n[k] - j * block)
        part = pa.table({"p_number": number[k], "p_block": j, "p_slot": slot + np.arange(len(k)), "p_start": start + np.cumsum(size) - size})
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(path)
        seen, slot, start = seen + times, slot + len(k), start + int(size.sum())
    return written_table(spark, path, kind)


def _places(rows: DataFrame, weights: Mapping[object, float] | None, block: int) -> DataFrame:
    """The columns of rows (__row, doc_id, source), a table, with block, slot, position and in_mix; __row tells rows apart."""
    spark = rows.sparkSession
    counts = sorted(((r["source"], r["count"]) for r in rows.groupBy("source").count().collect()), key=lambda x: str(x[0]))
    given = weights if weights is not None else {k: n**ALPHA for k, n in counts}
    live = [(i, n, float(given[k])) for i, (k, n) in enumerate(counts) if given.get(k) and given[k] > 0]
    plan = _plan(spark, *([x[c] for x in live] for c in range(3)), block)
    total = sum(w for _, _, w in live)
    horizon = min((int(-(-n // block) * (total / w) + EPS) for _, n, w in live), default=0)
    kind = rows.schema["source"].dataType.simpleString()
    number = spark.createDataFrame([(k, i, n, max(1, -(-n // SLICE))) for i, (k, n) in enumerate(counts)], f"s_source {kind}, number long, s_rows long, slices long")
    number = materialise(number, "sources")
    hashed = rows.withColumn("__h", F.when(F.col("doc_id").isNull(), F.xxhash64("__row")).otherwise(F.xxhash64("doc_id")))
    dealt = join_groups(hashed, number, [("source", "s_source")], "s_rows")
    dealt = dealt.select("__row", "doc_id", "source", "number", F.pmod(F.shiftrightunsigned("__h", 8), "slices").alias("slice"))
    sizes = dealt.groupBy("number", "slice").count()
    before = F.sum("count").over(Window.partitionBy("number").orderBy("slice")) - F.col("count")
    sizes = materialise(sizes.select("number", "slice", before.alias("before")), "slices")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("number", "slice").orderBy("doc_id", "__row")))
    placed = ranked.join(sizes, ["number", "slice"]).withColumn("index", F.col("before") + F.col("rank") - 1)
    placed = placed.select("__row", "doc_id", "source", "number", F.expr(f"`index` div {block}").alias("block"), F.expr(f"`index` % {block}").alias("inside"))
    out = placed.join(plan, (placed.number == plan.p_number) & (placed.block == plan.p_block), "left")
    in_mix = F.coalesce(F.col("p_slot") < F.lit(horizon), F.lit(False))
    return out.select("__row", "doc_id", "source", "block", F.col("p_slot").alias("slot"), (F.col("p_start") + F.col("inside")).alias("position"), in_mix.alias("in_mix"))


def mix(docs: DataFrame, weights: Mapping[object, float] | None = None, block: int = BLOCK, source: str = "source") -> DataFrame:
    """(doc_id, source, block, slot, position, in_mix) of every row of docs.

    Without weights, a source's is its number of documents to the power ALPHA, which lifts small sources. position is the
    place in the interleaved order, which holds every document of a source with a weight, 0 to their number less one: a source
    that runs dry leaves its share to the rest, and its last block may be a part of one. in_mix tells the slots before the
    first source runs dry, up to which all sources have their target weights to within a block. Weights of sources without
    rows are shared among the rest. Rows of sources without a weight have null slots and positions.
    Null sources are a source of their own. Rows that repeat a doc_id take neighbouring places of their own, and rows with a
    null doc_id places of their own anywhere in their source. An empty table gives an empty result. The driver holds one name
    and a few numbers a source.
    """
    with temporary_tables(docs.sparkSession) as keep:
        rows = materialise(docs.select("doc_id", F.col(source).alias("source"), F.monotonically_increasing_id().alias("__row")), "rows")
        return keep(materialise(_places(rows, weights, block).drop("__row"), "mix"))


def take(docs: DataFrame, weights: Mapping[object, float] | None = None, block: int = BLOCK, whole: bool = False) -> DataFrame:
    """The rows of docs in the mix, written in mixed order, with the columns of docs.

    With whole, every row of docs: those after the first source runs dry too, and last those of sources without a weight.
    Each row has its own place, as in mix: rows with a null doc_id stay, and rows that repeat one stay as often as they occur.
    An empty table gives an empty result. Columns of docs may have any name that doesn't begin with __.
    """
    with temporary_tables(docs.sparkSession) as keep:
        rows = keep(materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "rows"))
        places = _places(rows.select("__row", "doc_id", "source"), weights, block)
        places = places if whole else places.where("in_mix")
        places = keep(materialise(places.select(F.col("__row").alias("__place"), F.col("position").alias("__position")), "places"))
    order = F.col("__position").asc_nulls_last()
    out = rows.join(places.hint("merge"), F.col("__row") == F.col("__place")).repartitionByRange(ranges(rows), order)
    return out.sortWithinPartitions(order).select(*docs.columns)
