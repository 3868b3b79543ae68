"""Tensors as long tables (key, i, j, x): one row a value, whatever the sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.checks import assert_empty

COLUMNS = ("key", "i", "j", "x")


def write_tensors(tensors: DataFrame, path: str) -> None:
    tensors.select(*COLUMNS).write.parquet(path)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*COLUMNS)


def shapes(tensors: DataFrame) -> DataFrame:
    """(key, rows, cols), from the largest indices."""
    return tensors.groupBy("key").agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))


def low_rank_delta(b: DataFrame, a: DataFrame, scale: float | str = 1.0, transpose: bool = False) -> DataFrame:
    """The product of each key's b (i, rank) and a (rank, j), times scale (a number or a column of a); transposed if so wanted."""
    left, right = b.select("key", "i", F.col("j").alias("r"), F.col("x").alias("bx")), a.select("key", F.col("i").alias("r"), "j", (F.col("x") * (F.col(scale) if isinstance(scale, str) else F.lit(scale))).alias("ax"))
    out = left.join(right, ["key", "r"]).groupBy("key", "i", "j").agg(F.sum(F.col("bx") * F.col("ax")).alias("x"))
    return out.select("key", F.col("j").alias("i"), F.col("i").alias("j"), "x") if transpose else out


def shape_problems(delta: DataFrame, base: DataFrame) -> DataFrame:
    """(key, problem) of deltas without a base tensor, or of another shape than it."""
    want = shapes(base).select(F.col("key").alias("__key"), F.col("rows").alias("__rows"), F.col("cols").alias("__cols"))
    j = shapes(delta).join(want, F.col("key") == F.col("__key"), "left")
    problem = F.when(F.col("__key").isNull(), "no base").when((F.col("rows") != F.col("__rows")) | (F.col("cols") != F.col("__cols")), "shape")
    return j.select("key", problem.alias("problem")).where("problem IS NOT NULL")


def checked_delta(delta: DataFrame, base: DataFrame) -> DataFrame:
    """delta, after each of its tensors has the shape of its base."""
    assert_empty(shape_problems(delta, base), "deltas")
    return delta
