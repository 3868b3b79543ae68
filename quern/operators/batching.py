"""Batch planning: fixed batches of one dataset each, shuffled steps, rank slices and instruction rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import seeded_md5
from quern.operators.corpus import dense_ids


def plan(df: DataFrame, dataset: str, key: str, batch_size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """(dataset, batch_ordinal, position, key): each dataset in hash order, cut into full batches; the rest is left out."""
    order = seeded_md5(seed, epoch, F.col(dataset), F.col(key))
    sizes = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("__n"))
    out = dense_ids(df.select(dataset, key).withColumn("__o", order), ["__o", key], "__r", [dataset]).drop("__o").join(sizes, dataset)
    out = out.withColumn("batch_ordinal", F.expr(f"__r div {batch_size}")).withColumn("position", (F.col("__r") % batch_size).cast("long"))
    return out.where(F.col("batch_ordinal") < F.expr(f"__n div {batch_size}")).drop("__r", "__n")


def steps(batches: DataFrame, dataset: str, seed: int = 42, epoch: int = 0, block: int = 1) -> DataFrame:
    """(dataset, batch_ordinal, step): batches in hash order of blocks of block consecutive ones, ascending inside.

    The order is global: batches are ranked in ranges of it.
    """
    keyed = batches.select(dataset, "batch_ordinal").distinct().withColumn("__block", F.expr(f"batch_ordinal div {block}"))
    keyed = keyed.withColumn("__order", seeded_md5(seed, epoch, F.col(dataset), F.col("__block")))
    return dense_ids(keyed, ["__order", dataset, "batch_ordinal"], "step").drop("__block", "__order")


def rank_of(position: Column, batch_size: int, world_size: int) -> Column:
    """The rank whose equal slice of the global batch holds the position."""
    if batch_size % world_size:
        raise ValueError("the batch size must be a multiple of the world size")
    return F.floor(position / (batch_size // world_size)).cast("long")


def instruction(prompts: list[str], ordinal: Column, position: Column, batch_size: int, own: Column | None = None, default: str = "") -> Column:
    """The record's own prompt, else the dataset's prompts in turn over the plan, else the default."""
    turn = F.get(F.array(*map(F.lit, prompts)), F.pmod(ordinal * batch_size + position, F.lit(len(prompts))).cast("int")) if prompts else F.lit(None).cast("string")
    return F.coalesce(*([own] if own is not None else []), turn, F.lit(default))


def planned(df: DataFrame, dataset: str, batch_size: int) -> DataFrame:
    """(dataset, n_rows, n_batches, n_instances) of the plan without making it."""
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_batches", F.expr(f"n_rows div {batch_size}")).withColumn("n_instances", F.col("n_batches") * batch_size)
