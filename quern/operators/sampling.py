"""Deterministic sampling by hash order: uniform, without replacement, and independent of partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import seeded, seeded_md5, unit_seed
from quern.operators.corpus import dense_ids


def capped(df: DataFrame, unit: list[str], key: Column, limit: int | Column, seed: int = 42, profile: str = "default") -> DataFrame:
    """At most limit rows of each unit, those of least hash; all rows of a smaller unit. limit may be a column."""
    order = seeded_md5(seed, profile, *(F.col(u) for u in unit), key)
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*unit).orderBy(order, key))).where(F.col("__rank") <= limit).drop("__rank")


def factor(df: DataFrame, unit: list[str], key: Column, by: float, seed: int = 42) -> DataFrame:
    """int(n * by) rows of each unit; by over 1 repeats whole passes, the last one cut in hash order. Adds pass."""
    if by <= 0:
        raise ValueError("the factor must be positive")
    sizes = df.groupBy(*unit).agg(F.count(F.lit(1)).alias("__n"))
    out = df.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(-(-by // 1)) - 1))))
    out = out.withColumns({"__o": seeded_md5(seed, F.col("pass"), *(F.col(u) for u in unit), key), "__k": key})
    ranked = dense_ids(out, ["__o", "__k"], "__place", [*unit, "pass"]).join(sizes, unit)
    quota = F.floor(F.col("__n") * F.lit(by)) - F.col("pass") * F.col("__n")
    return ranked.where(F.col("__place") < quota).drop("__place", "__n", "__o", "__k")


def reservoir(df: DataFrame, key: Column, k: int, seed: int = 42) -> DataFrame:
    """k rows of the table: the k of least hash, kept per task before they meet."""
    return df.orderBy(seeded_md5(seed, key), key).limit(k)


def rank_band(df: DataFrame, unit: list[str], order: list[Column], key: Column, lo: int, hi: int, k: int, seed: int = 42) -> DataFrame:
    """k rows of each unit, by seeded hash, of those at places lo to hi of the order."""
    w = Window.partitionBy(*unit)
    band = df.withColumn("__rank", F.row_number().over(w.orderBy(*order))).where(F.col("__rank").between(lo, hi))
    h = seeded_md5(seed, *(F.col(u) for u in unit), key)
    return band.withColumn("__pick", F.row_number().over(w.orderBy(h, key))).where(F.col("__pick") <= k).drop("__rank", "__pick")


def partition_negatives(df: DataFrame, unit: str, key: str, draws: int) -> DataFrame:
    """(key, negative): seeded draws from the row's own unit that are never the row itself, each of a unit of two rows or more.

    A draw is a step from the row's dense number in the unit, so no pairs are made.
    """
    r = dense_ids(df.select(unit, key), [key], "__i", [unit])
    n = df.groupBy(unit).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    d = r.join(n, unit).withColumn("__d", F.explode(F.array(*map(F.lit, range(draws))))).withColumn("__h", seeded(F.col("__d"), F.col(key)))
    d = d.select(key, unit, F.expr("(__i + 1 + __h % (__n - 1)) % __n").alias("__i"))
    return d.join(r.withColumnRenamed(key, "negative"), [unit, "__i"]).select(key, "negative").distinct()


def choose(items: Column, seed: Column) -> Column:
    """One element by a seeded index."""
    return F.get(items, F.pmod(seed, F.size(items)).cast("int"))


def choose_many(items: Column, k: int, seed: Column) -> Column:
    """k elements: without replacement if there are enough, else the list is repeated ceil(k / n) times first."""
    n = F.size(items)
    times = F.when(n >= k, F.lit(1)).otherwise(F.ceil(F.lit(k) / F.greatest(n, F.lit(1))).cast("int"))
    repeated = F.flatten(F.array_repeat(items, times))
    tagged = F.transform(repeated, lambda x, i: F.struct(F.md5(F.concat_ws("|", seed.cast("string"), i.cast("string"))).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.slice(F.sort_array(tagged), 1, k), lambda z: z["x"])


def with_replacement(items: Column, k: int, seed: Column) -> Column:
    """The list itself if it has k or more elements, cut to k in order; else k seeded draws."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.get(items, F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), i.cast("string"))), 1, 15), 16, 10).cast("long"), F.size(items)).cast("int")))
    return F.when(F.size(items) >= k, F.slice(items, 1, k)).otherwise(draws)


def pcg64_indices(n: int, limit: int, seed: int) -> list[int]:
    """The sorted row numbers that numpy's PCG64 generator draws; all rows when there are no more than limit."""
    import numpy as np

    if n <= limit:
        return list(range(n))
    return sorted(int(i) for i in np.random.Generator(np.random.PCG64(seed)).choice(n, size=limit, replace=False))


def pcg64_units(units: DataFrame, unit: str, n: str, limit: int, seed: int, profile: str) -> DataFrame:
    """(unit, logical): for each unit (unit, n) the sorted logical rows that PCG64 draws with the unit's own seed.

    Units are drawn where they lie; a draw holds a unit's row numbers in memory, as the generator needs them.
    """
    kind = units.schema[unit].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (u, rows) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                at = pa.array(pcg64_indices(rows, limit, unit_seed(seed, profile, u)), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(at), pa.int64())), at], names=[unit, "logical"])

    return units.select(unit, F.col(n).cast("long").alias(n)).mapInArrow(run, f"`{unit}` {kind}, logical long")
