"""Catalogue operators: three levels (source, unit, shard), profiles, overrides, row ranges and their checks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.checks import ConstraintError, assert_empty
from quern.operators.corpus import dense_ids, ranged
from quern.session import materialise


def explode_catalog(sources: DataFrame) -> DataFrame:
    """Nested sources (source_id, units[unit_id, shards[path, row_start, row_stop]]) to one row a shard."""
    units = sources.select("source_id", F.posexplode("units").alias("unit_ordinal", "unit"))
    return units.select("source_id", "unit_ordinal", F.col("unit.unit_id").alias("unit_id"), F.posexplode("unit.shards").alias("shard_ordinal", "shard")).select("source_id", "unit_ordinal", "unit_id", "shard_ordinal", "shard.*")


def exclusion_status(units: DataFrame, contaminated: Column, include_contaminated: bool, include: list[str], exclude: list[str], key: str) -> DataFrame:
    """units with excluded and reason. Contaminated sources are out unless wanted; an included unit clears that; an excluded one overrides all."""
    if set(include) & set(exclude):
        raise ValueError(f"both included and excluded: {sorted(set(include) & set(exclude))}")
    reason = F.when(F.col(key).isin(exclude), "excluded").when(F.col(key).isin(include), None).when(contaminated & F.lit(not include_contaminated), "contaminated")
    return units.withColumn("reason", reason).withColumn("excluded", F.col("reason").isNotNull())


def overlaps(shards: DataFrame) -> DataFrame:
    """Pairs of shards of one path whose row ranges overlap; a missing range is the whole file.

    Shards are dealt in ranges of (path, start), so one path may fill many tasks. A shard that reaches beyond the last start
    of its own range is also sent to the later ranges that it meets, and each range is swept once: a pair is found where the
    later of both starts, so the work is the sort, the pairs found, and what reaches over. Shards without rows or a path
    overlap nothing, nor do rows that share a shard_id; a null shard_id is left out.
    """
    r = shards.select("path", "shard_id", F.coalesce("row_start", F.lit(0)).cast("long").alias("start"), F.coalesce("row_stop", F.lit(1 << 62)).cast("long").alias("stop"))
    dealt = ranged(r.where("start < stop AND shard_id IS NOT NULL AND path IS NOT NULL"), ["path", "start"])
    bounds = dealt.groupBy("path", "__part").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    cut = bounds.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path")
    bounds = materialise(bounds.join(cut, "path", "left_semi"), "bounds")  # paths in several ranges: two rows a range at most
    own, later = bounds.select("path", "__part", "hi"), bounds.select("path", F.col("__part").alias("at"), "lo")
    over = dealt.join(own, ["path", "__part"]).where("stop > hi").join(later, "path").where("at > __part AND lo < stop")
    kind = shards.schema["shard_id"].dataType.simpleString()
    rows = lambda d, part, starts: d.select(F.col(part).alias("part"), "path", "shard_id", "start", "stop", F.lit(starts).alias("here"))
    swept = rows(dealt, "__part", True).unionByName(rows(over, "at", False)).groupBy("part", "path").applyInArrow(_sweep, f"path string, shard_a {kind}, shard_b {kind}")
    return swept.select(F.col("path").cast(shards.schema["path"].dataType), "shard_a", "shard_b")


def _sweep(t: pa.Table) -> pa.Table:
    """Pairs of ranges that overlap, the later of which starts here, from one path's ranges in order of their starts."""
    t = t.sort_by([("here", "ascending"), ("start", "ascending")])
    starts, stops, here = (t.column(c).to_numpy() for c in ("start", "stop", "here"))
    open_, left, right = np.flatnonzero(~here), [], []
    for i in np.flatnonzero(here):
        open_ = open_[stops[open_] > starts[i]]  # each one is dropped once, and gives a pair until then
        left.append(open_)
        right.append(np.full(len(open_), i))
        open_ = np.append(open_, i)
    ids = t.column("shard_id")
    a, b = ids.take(pa.array(np.concatenate(left or [[]]).astype(np.int64))), ids.take(pa.array(np.concatenate(right or [[]]).astype(np.int64)))
    first = pc.less(a, b)
    out = pa.table({"path": pa.array([t.column("path")[0].as_py()] * len(a), pa.string()), "shard_a": pc.if_else(first, a, b), "shard_b": pc.if_else(first, b, a)})
    return out.filter(pc.not_equal(a, b))


def offsets(shards: DataFrame, unit: str, order: list[str], rows: str) -> DataFrame:
    """shards with lo and hi: the logical rows of the unit that each one holds."""
    total = F.sum(rows).over(Window.partitionBy(unit).orderBy(*order))
    return shards.withColumn("hi", total).withColumn("lo", total - F.col(rows))


STRETCH = 1 << 20


def locate(rows: DataFrame, shards: DataFrame, unit: str, row: str) -> DataFrame:
    """Logical rows with their shard and the row inside it; rows beyond the last shard are left out.

    The range join is an equality on stretches of STRETCH rows: a row lies in one, a shard in those that it touches. A
    stretch has few shards and a bounded number of rows, so a unit of any size is spread over many tasks.
    """
    stretch = f"explode(sequence(lo div {STRETCH}, greatest(lo, hi - 1) div {STRETCH})) AS __stretch"
    s = shards.where("hi > lo").selectExpr(unit, "shard_id", "lo", "hi", stretch)
    r = rows.select(unit, F.col(row).cast("long").alias(row)).withColumn("__stretch", F.expr(f"`{row}` div {STRETCH}"))
    return r.join(s, [unit, "__stretch"]).where((F.col(row) >= F.col("lo")) & (F.col(row) < F.col("hi"))).select(unit, row, "shard_id", (F.col(row) - F.col("lo")).alias("inner_row"))


def apply_overrides(units: DataFrame, overrides: DataFrame, source: str) -> DataFrame:
    """units (source, units array) with an override's units in place of the base ones."""
    o = overrides.select(F.col(source).alias("__s"), F.col("units").alias("__u"))
    return units.join(o, units[source] == o["__s"], "left").withColumn("units", F.coalesce("__u", "units")).withColumn("overridden", F.col("__s").isNotNull()).drop("__s", "__u")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with side; empty if both are equal as multisets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def merge_manifest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union by key; rebuilt rows win."""
    a, b = (d.select(F.col(key), F.struct(*(c for c in d.columns if c != key)).alias(n)) for d, n in ((old, "o"), (new, "n")))
    return a.join(b, key, "full_outer").select(key, F.coalesce("n", "o").alias("__r"), F.col("n").isNotNull().alias("rebuilt")).select(key, "__r.*", "rebuilt")


def islands(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n_islands): runs of each key in the order of the table; more than one is a gap.

    Changes are found inside ranges of the order; a range's first row is compared with the last key of the range before.
    """
    dealt = ranged(df.select(key, F.col(order).alias("__o")), ["__o"])
    last = dealt.groupBy("__part").agg(F.max_by(key, "__o").alias("__last"))
    last = last.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__before"))  # one row a range
    before = F.coalesce(F.lag(key).over(Window.partitionBy("__part").orderBy("__o")), "__before")
    change = F.coalesce((before != F.col(key)).cast("int"), F.lit(1))
    return dealt.join(last, "__part").withColumn("__c", change).groupBy(key).agg(F.sum("__c").alias("n_islands"))


def lockstep_mismatch(a: DataFrame, b: DataFrame, unit: str, value: str) -> DataFrame:
    """(unit, problem) where the ordered values of a unit differ between both sides, compared place by place."""
    listed = lambda d, n: dense_ids(d.select(unit, F.col(value).alias(n)), [n], "__k", [unit])
    j = listed(a, "__x").join(listed(b, "__y"), [unit, "__k"], "full_outer")
    j = j.groupBy(unit).agg(F.count("__x").alias("n_x"), F.count("__y").alias("n_y"), F.count_if(~F.col("__x").eqNullSafe(F.col("__y"))).alias("n_differ"))
    problem = F.when(F.col("n_x") == 0, "left missing").when(F.col("n_y") == 0, "right missing").otherwise("differs")
    return j.where("n_differ > 0").select(unit, problem.alias("problem"))


def first_match(df: DataFrame, key: str, candidates: str, known: DataFrame, name: str) -> DataFrame:
    """(key, resolved): the first of a row's ordered candidates that is known (known has a column of that name)."""
    c = df.select(key, F.posexplode(candidates).alias("__pri", "__cand"))
    found = c.join(known.select(F.col(name).alias("__cand")).distinct(), "__cand")
    return found.groupBy(key).agg(F.min_by("__cand", "__pri").alias("resolved"))


def side_pairs(df: DataFrame, prefix: str, side: str, value: str) -> DataFrame:
    """(prefix, a, b, problem) from rows that hold one side (a or b) of a pair each; problem names what is missing or repeated."""
    one = lambda x: F.max(F.when(F.col(side) == x, F.col(value))).alias(x)
    n = lambda x: F.count_if(F.col(side) == x).alias(f"n_{x}")
    out = df.groupBy(prefix).agg(one("a"), one("b"), n("a"), n("b"))
    problem = F.when(F.col("n_a") == 0, "no a").when(F.col("n_b") == 0, "no b").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "repeated")
    return out.select(prefix, "a", "b", problem.alias("problem"))


def complete_pairs(df: DataFrame, prefix: str, side: str, value: str) -> DataFrame:
    """(prefix, a, b); an incomplete or repeated pair is an error, and so is a table without pairs."""
    pairs = side_pairs(df, prefix, side, value)
    assert_empty(pairs.where("problem IS NOT NULL").select(prefix, "problem"), "pairs")
    if not pairs.take(1):
        raise ConstraintError("no pairs")
    return pairs.drop("problem")


def stale_units(wanted: DataFrame, stored: DataFrame, files: DataFrame, unit: str, keys: list[str], needed: list[str]) -> DataFrame:
    """(unit, reason) of wanted units (unit, keys) that can't be taken from what is stored.

    A unit is missing if stored (unit, keys) lacks it, stale by the first of its keys that differs, and incomplete if files
    (unit, file) lacks one of the needed files.
    """
    s = stored.select(F.col(unit).alias("__unit"), *(F.col(k).alias(f"__{k}") for k in keys))
    there = files.where(F.col("file").isin(needed)).groupBy(F.col(unit).alias("__of")).agg(F.countDistinct("file").alias("__files"))
    j = wanted.join(s, F.col(unit) == F.col("__unit"), "left").join(there, F.col(unit) == F.col("__of"), "left")
    reason = F.when(F.col("__unit").isNull(), "missing")
    for k in keys:
        reason = reason.when(~F.col(k).eqNullSafe(F.col(f"__{k}")), f"stale {k}")
    reason = reason.when(F.coalesce("__files", F.lit(0)) < len(needed), "incomplete")
    return j.select(unit, reason.alias("reason")).where("reason IS NOT NULL")


def manifest_units(metadata: DataFrame, text: str, required: list[str], optional: list[str]) -> DataFrame:
    """Fixed columns from the JSON text of each unit's metadata: paths follow from unit_id, optional numbers may be null.

    A row without a unit id or one of the required numbers is an error.
    """
    m = F.from_json(text, "map<string,string>")
    get = lambda k, kind="long": F.try_element_at(m, F.lit(k)).cast(kind).alias(k)
    out = metadata.select(get("unit_id", "string"), get("source_id", "string"), get("language", "string"), *(get(k) for k in required), *(get(k) for k in optional))
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in ("unit_id", *required)))
    assert_empty(out.where(missing), "metadata")
    path = lambda f: F.concat(F.lit("units/"), "unit_id", F.lit(f)).alias
    return out.select("*", F.lit(True).alias("enabled"), path("")("directory"), path("/queries.arrow")("queries_path"), path("/corpus.arrow")("corpus_path"))


MOST_PAIRED = 4096


def unordered_pairs(df: DataFrame, key: str) -> DataFrame:
    """(i, j), i < j, of all keys: for small sets such as models to compare; over MOST_PAIRED of them are an error."""
    if (n := df.count()) > MOST_PAIRED:
        raise ConstraintError(f"{n} keys give too many pairs")
    return df.select(F.col(key).alias("i")).join(df.select(F.col(key).alias("j")), F.col("i") < F.col("j"))


def task_keys(tasks: DataFrame, suffix: str, parts: str = "parts", default: str = "default") -> DataFrame:
    """(path, revision, subset), once each, of the tasks whose type ends with suffix; the default subset is null.

    tasks: (type, path, revision, subset, parts). One with parts, a list of (type, path, revision, subset), is an aggregate:
    its parts are judged in its place. Parts of a null or empty list are none, so the task itself is judged; null types end
    with nothing.
    """
    fields = ("type", "path", "revision", "subset")
    leaves = F.when(F.size(parts) > 0, F.transform(parts, lambda p: F.struct(*(p[f].alias(f) for f in fields)))).otherwise(F.array(F.struct(*fields)))
    found = tasks.select(F.inline(leaves)).where(F.col("type").endswith(suffix))
    return found.select("path", "revision", F.nullif(F.col("subset"), F.lit(default)).alias("subset")).distinct()


def compare_results(left: DataFrame, right: DataFrame, keys: list[str], score: str, audits: list[str]) -> DataFrame:
    """Results of two runs side by side: (keys, left_score, right_score, delta, found, left_audit, right_audit, same_audit, ...).

    found is left, right or both. A key that is null meets a null one, and a key that repeats on a side meets each row of the
    other. delta is right less left, null where either is. same_ tells, for columns that should agree before scores are
    compared (revisions, numbers of rows), whether they do; it is null for results of one side alone.
    """
    side = lambda df, s: df.select(*(F.col(k).alias(f"__{s}_{k}") for k in keys), *(F.col(c).alias(f"{s}_{c}") for c in (score, *audits)), F.lit(True).alias(f"__{s}"))
    on = [F.col(f"__left_{k}").eqNullSafe(F.col(f"__right_{k}")) for k in keys]
    j = side(left, "left").join(side(right, "right"), on, "full_outer")
    both = F.col("__left") & F.col("__right")
    found = F.when(both, "both").when(F.col("__left"), "left").otherwise("right")
    out = [F.when(F.col("__left"), F.col(f"__left_{k}")).otherwise(F.col(f"__right_{k}")).alias(k) for k in keys]
    out += [F.col(f"left_{score}"), F.col(f"right_{score}"), (F.col(f"right_{score}") - F.col(f"left_{score}")).alias("delta"), found.alias("found")]
    for a in audits:
        out += [F.col(f"left_{a}"), F.col(f"right_{a}"), F.when(both, F.col(f"left_{a}").eqNullSafe(F.col(f"right_{a}"))).alias(f"same_{a}")]
    return j.select(*out)
