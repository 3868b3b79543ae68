"""Corpus compilation: valid rows, wide to nested negatives, exact deduplication with dense ids, dereferencing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import materialise, partitions


def negative_columns(columns: list[str]) -> list[str]:
    """negative_<number> columns in order of the number."""
    found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(r"negative_(\d+)", c))]
    return [c for _, c in sorted(found)]


def is_text(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def nest_negatives(df: DataFrame) -> DataFrame:
    """Wide rows with negatives array<string>: null and empty ones go, order stays; n_removed counts them."""
    cols = negative_columns(df.columns)
    if not cols:
        raise ValueError("no negative column")
    every = F.array(*cols)
    return df.withColumn("negatives", F.filter(every, is_text)).withColumn("n_removed", F.size(every) - F.size("negatives")).drop(*cols)


def valid_rows(df: DataFrame, *texts: str) -> DataFrame:
    cond = F.lit(True)
    for t in texts:
        cond &= is_text(F.col(t))
    return df.where(cond)


def drop_report(df: DataFrame, *texts: str) -> DataFrame:
    """selected, valid, dropped: valid + dropped = selected."""
    cond = F.lit(True)
    for t in texts:
        cond &= is_text(F.col(t))
    return df.agg(F.count(F.lit(1)).alias("selected"), F.count_if(cond).alias("valid"), F.count_if(~cond).alias("dropped"))


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in ranges of order, written, with the number of the range as __part: later passes see the same ranges."""
    n = partitions(df.sparkSession)
    return materialise(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def dense_ids(df: DataFrame, order: list[str], name: str, unit: list[str] | None = None) -> DataFrame:
    """Dense ids from 0 in the given order, within each unit if there is one.

    Rows are ranked inside ranges of (unit, order) and the rows of the ranges before are added, so no task sees more than
    a range, however many rows a unit holds. Ties in order get ids in no particular order.
    """
    unit = unit or []
    dealt = ranged(df, [*unit, *order])
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    inner = dealt.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*unit, *order)))
    out = inner.join(before, "__part").withColumn(name, F.col("__before") + F.col("__rank") - 1).drop("__part", "__rank", "__before")
    if not unit:
        return out
    starts = out.groupBy(*unit).agg(F.min(name).alias("__start"))
    return out.join(starts, unit).withColumn(name, F.col(name) - F.col("__start")).drop("__start")


def running(df: DataFrame, unit: list[str], order: list[str], **sums: Column) -> DataFrame:
    """df with running sums in order within each unit, the row itself included.

    Sums run inside ranges, and what the ranges before hold of the unit is added, so no task sees more than a range.
    """
    dealt = ranged(df.withColumns({f"__{n}": c for n, c in sums.items()}), [*unit, *order])
    totals = dealt.groupBy("__part", *unit).agg(*(F.sum(f"__{n}").alias(f"__t_{n}") for n in sums))
    w = Window.partitionBy(*unit).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    carried = totals.select("__part", *(F.col(u).alias(f"__u_{i}") for i, u in enumerate(unit)), *(F.coalesce(F.sum(f"__t_{n}").over(w), F.lit(0)).alias(f"__c_{n}") for n in sums))
    inner = Window.partitionBy("__part", *unit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"__r_{n}": F.sum(f"__{n}").over(inner) for n in sums}).withColumnRenamed("__part", "__at")
    same = F.col("__at") == F.col("__part")
    for i, u in enumerate(unit):
        same &= F.col(u).eqNullSafe(F.col(f"__u_{i}"))
    return out.join(carried, same).select(*df.columns, *((F.coalesce(f"__r_{n}", F.lit(0)) + F.col(f"__c_{n}")).alias(n) for n in sums))


def lagged(df: DataFrame, unit: list[str], order: list[str], **values: str) -> DataFrame:
    """df with values of the row before in its unit (null for the first one), found inside ranges of the order.

    A range's first row is given the last row of the range before.
    """
    dealt = ranged(df, [*unit, *order])
    held = F.struct(*(F.col(u).alias(f"u{i}") for i, u in enumerate(unit)), *(F.col(c).alias(n) for n, c in values.items()))
    last = dealt.groupBy("__part").agg(F.max_by(held, F.struct(*unit, *order)).alias("__last"))
    last = last.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__last"))  # one row a range
    near = dealt.withColumn("__near", F.lag(held).over(Window.partitionBy("__part").orderBy(*unit, *order)))
    out = near.join(last, "__part").withColumn("__before", F.coalesce("__near", "__last"))
    same = F.col("__before").isNotNull()
    for i, u in enumerate(unit):
        same &= F.col(f"__before.u{i}").eqNullSafe(F.col(u))
    return out.select(*df.columns, *(F.when(same, F.col(f"__before.{n}")).alias(n) for n in values))


FAN = 1024


def fingerprint(df: DataFrame, unit: list[str], order: list[str], value: str) -> DataFrame:
    """(unit, fingerprint): sha256 of the unit's values in order, joined by commas.

    Over FAN values, that of the digests of each FAN in turn, and so on, so no task sees a whole unit.
    """
    rows = df.select(*unit, *dict.fromkeys([*order, value]))
    d = dense_ids(rows, order, "__i", unit).select(*unit, "__i", F.col(value).cast("string").alias("__v"))
    n, first = None, True
    while n is None or n > 1:
        listed = F.sort_array(F.collect_list(F.struct("__i", "__v")))
        d = d.groupBy(*unit, F.expr(f"__i div {FAN}").alias("__b")).agg(listed.alias("__l"))
        digest = F.sha2(F.array_join(F.transform("__l", lambda x: x["__v"]), ","), 256)
        d = d.select(*unit, F.col("__b").alias("__i"), (digest if first else F.when(F.size("__l") == 1, F.get("__l", F.lit(0))["__v"]).otherwise(digest)).alias("__v"))
        d, first = materialise(d, "digests"), False
        n = (d.agg(F.max("__i")).first()[0] or 0) + 1
    return d.select(*unit, F.col("__v").alias("fingerprint"))


def dedup(df: DataFrame, text: str, ordinal: str, unit: list[str] | None = None) -> DataFrame:
    """Distinct texts with dense doc_id by first occurrence, their digest and number of uses."""
    unit = unit or []
    first = df.groupBy(*unit, F.sha2(F.col(text), 256).alias("digest"), F.col(text).alias("text")).agg(F.min(ordinal).alias("first_seen"), F.count(F.lit(1)).alias("n_refs"))
    return dense_ids(first, ["first_seen"], "doc_id", unit)


def dereference(df: DataFrame, ids: str, corpus: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, texts) with ids replaced by their documents' texts in order; a missing document leaves a null."""
    long = df.select(key, F.posexplode(ids).alias("pos", "__id"))
    found = long.join(corpus.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")), "__id", "left")
    listed = F.sort_array(F.collect_list(F.struct("pos", F.col("__text").alias("text"))))
    return found.groupBy(key).agg(F.transform(listed, lambda x: x["text"]).alias("texts"))


def neighbours(df: DataFrame, unit: list[str], order: str) -> DataFrame:
    """(order, near): for each row the next one of its unit in order, for the last one the first."""
    ids = dense_ids(df.select(*unit, order), [order], "__k", unit)
    n = df.groupBy(*unit).agg(F.count(F.lit(1)).alias("__n"))
    following = ids.join(n, unit).select(*unit, order, F.expr("(__k + 1) % __n").alias("__k"))
    return following.join(ids.withColumnRenamed(order, "near"), [*unit, "__k"]).select(order, "near")


def known_lists(df: DataFrame, key: str, ids: str, corpus: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(key, n) of the rows whose listed documents are all in the corpus, with their number; other rows are left out."""
    e = df.select(key, F.explode(ids).alias("__ref"))
    known = corpus.select(F.col(doc_id).alias("__ref"), F.lit(True).alias("__known"))
    found = e.join(known, "__ref", "left").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.every(F.col("__known").isNotNull()).alias("__ok"))
    return found.where("__ok").drop("__ok")


def reference_counts(df: DataFrame, ids: str) -> DataFrame:
    return df.select(F.explode(ids).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_refs"))


def dictionary(df: DataFrame, text: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """Unique texts with codes by first occurrence, and rows (ordinal, code)."""
    uniques = dense_ids(df.groupBy(F.col(text).alias("text")).agg(F.min(ordinal).alias("first_seen")), ["first_seen"], "code")
    return uniques, df.join(uniques, df[text] == uniques["text"]).select(ordinal, "code")


def has_negatives(qrels: DataFrame, unit: str, score: str) -> DataFrame:
    """(unit, has_negatives): whether the judgements of a unit hold one of score 0; null scores are none."""
    return qrels.groupBy(unit).agg(F.coalesce(F.max((F.col(score) == 0).cast("int")) == 1, F.lit(False)).alias("has_negatives"))


def recovered_candidates(qrels: DataFrame, unit: str, score: str) -> DataFrame:
    """The judgements that can stand in for missing candidate lists: all of the units in which some score is 0.

    Where every judged document is relevant, ranking the judged ones alone would be perfect by construction, so such units
    give none. Null units are never recovered. Columns are those of qrels.
    """
    return qrels.join(has_negatives(qrels, unit, score).where("has_negatives").select(unit), unit, "left_semi").select(*qrels.columns)
