"""Exact quantiles of groups of any size: equal values are counted first, the rest is selected by rank in ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.corpus import ranged
from quern.session import materialise


def selected(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column], times: str | None = None) -> DataFrame:
    """(by, n, <name>...): for each name the value at that rank (from 1, an expression over n) of each group in order.

    times names a column that says how often a row counts.

    Distinct values are counted before the shuffle and dealt in ranges of (by, value). The running count of the ranges tells
    which range holds a rank, and only those are sorted, so no task sees more of a group than a range. Null values don't
    count, a group without others is left out, and a null in by is a group of its own.
    """
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))) if by else F.struct(F.lit(0).alias("k0"))
    rows = df.select(key.alias("__g"), F.col(value).alias("__v"), (F.col(times) if times else F.lit(1)).alias("__c"))
    counts = rows.where("__v IS NOT NULL").groupBy("__g", "__v").agg(F.sum("__c").alias("__c"))
    dealt = ranged(counts, ["__g", "__v"])
    parts = dealt.groupBy("__part", "__g").agg(F.sum("__c").alias("__own"))
    order = Window.partitionBy("__g").orderBy("__part")  # a row for each range that holds some of a group
    parts = materialise(parts.withColumn("__upto", F.sum("__own").over(order)), "parts")
    sizes = parts.groupBy("__g").agg(F.max("__upto").alias("n"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()))
    targets = sizes.select("__g", "n", F.explode(wanted).alias("t")).select("__g", "n", "t.name", "t.rank")
    at = parts.join(targets, "__g").where("rank <= __upto AND rank > __upto - __own").select("__g", "__part", "n", "name", (F.col("rank") - F.col("__upto") + F.col("__own")).alias("rank"))
    near = dealt.join(at.select("__g", "__part").distinct(), ["__g", "__part"], "left_semi")
    near = near.withColumn("__stop", F.sum("__c").over(Window.partitionBy("__g", "__part").orderBy("__v")))
    found = near.join(at, ["__g", "__part"]).where("rank <= __stop AND rank > __stop - __c")
    out = found.groupBy("__g", "n").agg(*(F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in ranks))
    return out.select(*(F.col(f"__g.k{i}").alias(c) for i, c in enumerate(by)), "n", *ranks)


def join_groups(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of a row a group, joined; nulls in by are equal."""
    if not by:
        return a.crossJoin(b)  # one row each
    c = b.withColumnsRenamed({k: f"__{k}" for k in by})
    same = F.lit(True)
    for k in by:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return a.join(c, same, "left").drop(*(f"__{k}" for k in by))


def nearest_ranks(df: DataFrame, by: list[str], value: str, times: str | None = None, **shares: float) -> DataFrame:
    """(by, n, <name>...) with the value at rank ceil(share * n), 1 at least, of each group."""
    return selected(df, by, value, {name: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q))) for name, q in shares.items()}, times)


def interpolated(df: DataFrame, by: list[str], value: str, times: str | None = None, **shares: float) -> DataFrame:
    """(by, n, <name>...) with linear interpolation at (n - 1) * share between the two values next to it."""
    place = lambda q: (F.col("n") - 1) * F.lit(q)
    ranks = {f"{name}__{side}": cut(place(q)) + 1 for name, q in shares.items() for side, cut in (("lo", F.floor), ("hi", F.ceil))}
    rows = selected(df, by, value, ranks, times)
    between = lambda name, q: F.col(f"{name}__lo") + (F.col(f"{name}__hi") - F.col(f"{name}__lo")) * (place(q) - F.floor(place(q)))
    return rows.select(*by, "n", *(between(name, q).alias(name) for name, q in shares.items()))
