"""Constraints: violations as DataFrames, and assertions that raise when any exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.operators.corpus import lagged

TASK_TYPES = ("retrieval", "clustering", "classification")


class ConstraintError(ValueError):
    """Data breaks a constraint."""


def assert_empty(violations: DataFrame, what: str) -> None:
    rows = violations.limit(10).collect()
    if rows:
        raise ConstraintError(f"{what}: {[r.asDict() for r in rows]}")


def assert_schema(df: DataFrame, expected: StructType, ordered: bool = True) -> DataFrame:
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in expected]
    if (have != want) if ordered else (sorted(map(str, have)) != sorted(map(str, want))):
        raise ConstraintError(f"schema is {df.schema.simpleString()}, not {expected.simpleString()}")
    return df


def assert_count(df: DataFrame, expected: int) -> DataFrame:
    if (n := df.count()) != expected:
        raise ConstraintError(f"{n} rows, not {expected}")
    return df


def differences(tables: dict[str, DataFrame], key: str, values: list[str]) -> DataFrame:
    """(key, problem) where tables of a row a key don't agree: who lacks the key, or whose value differs from the first one's.

    All tables are stacked and grouped by key once, whatever their number. A key that repeats in a table is a problem too.
    """
    names = list(tables)
    rows = [df.select(F.col(key), F.struct(*(F.col(v).cast("string").alias(v) for v in values)).alias("__v"), F.lit(n).alias("__of")) for n, df in tables.items()]
    stacked = rows[0]
    for r in rows[1:]:
        stacked = stacked.unionByName(r)
    one = stacked.groupBy(key, "__of").agg(F.min("__v").alias("__v"), F.count(F.lit(1)).alias("__n"))
    per = one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__of", F.struct("__v", "__n")))).alias("__m"))  # an entry a table
    at = lambda n: F.try_element_at("__m", F.lit(n))
    base = F.coalesce(*(at(n)["__v"] for n in names))
    problem = F.lit(None).cast("string")
    for n in reversed(names):
        own = F.when(at(n).isNull(), F.lit(f"{n} lacks it")).when(at(n)["__n"] > 1, F.lit(f"{n} repeats it"))
        for v in values:
            own = own.when(~at(n)["__v"][v].eqNullSafe(base[v]), F.concat(F.lit(f"{n} has {v} "), F.coalesce(at(n)["__v"][v], F.lit("null")), F.lit(", not "), F.coalesce(base[v], F.lit("null"))))
        problem = F.coalesce(own, problem)
    return per.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def assert_aligned(tables: dict[str, DataFrame], key: str, values: list[str]) -> None:
    """An error with the first ten differences by key, and their number, unless all tables agree."""
    bad = differences(tables, key, values)
    if first := bad.orderBy(key).limit(10).collect():
        raise ConstraintError(f"{bad.count()} keys differ: " + "; ".join(f"{r[0]}: {r[1]}" for r in first))


def metadata_problems(stored: DataFrame, expected: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, field, stored, expected), a row for each value that isn't what is expected, as texts; null equals null.

    A key that one side lacks is one problem, of the field named like the key. Neither side should repeat a key.
    """
    side = lambda df, s: df.select(F.col(key).alias(f"__{s}_key"), *(F.col(v).cast("string").alias(f"{s}_{i}") for i, v in enumerate(values)), F.lit(True).alias(f"__{s}"))
    j = side(stored, "s").join(side(expected, "e"), F.col("__s_key").eqNullSafe(F.col("__e_key")), "full_outer")
    one = lambda name, a, b: F.struct(F.lit(name).alias("field"), a.alias("stored"), b.alias("expected"))
    lacks = one(key, F.col("__s_key").cast("string"), F.col("__e_key").cast("string"))
    wrong = [F.when(~F.col(f"s_{i}").eqNullSafe(F.col(f"e_{i}")), one(v, F.col(f"s_{i}"), F.col(f"e_{i}"))) for i, v in enumerate(values)]
    found = F.when(F.col("__s") & F.col("__e"), F.array_compact(F.array(*wrong))).otherwise(F.array(lacks))
    return j.select(F.coalesce("__s_key", "__e_key").alias(key), F.inline(found))


def assert_metadata(stored: DataFrame, expected: DataFrame, key: str, values: list[str]) -> DataFrame:
    """stored, after all its values are what is expected."""
    assert_empty(metadata_problems(stored, expected, key, values).orderBy(key, "field"), "metadata")
    return stored


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def index_violations(df: DataFrame, shard: str, index: str, ordinal: str, rows: Column | None = None) -> DataFrame:
    """Rows whose index isn't above the one before in the shard, or is out of range; previous is that one."""
    bad = (F.col(index) < 0) | (F.col("previous").isNotNull() & (F.col(index) <= F.col("previous")))
    return lagged(df, [shard], [ordinal], previous=index).where(bad | (F.col(index) >= rows) if rows is not None else bad)


def dense_id_report(df: DataFrame, *ids: str) -> DataFrame:
    """One row an id column: rows, least, most, distinct, and whether they are exactly 0 to rows - 1."""
    stats = df.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}_{c}") for c in ids for k, f in (("min", F.min), ("max", F.max), ("d", F.countDistinct))))
    parts = F.array(*(F.struct(F.lit(c).alias("id_name"), F.col("n").alias("n_rows"), F.col(f"min_{c}").cast("long").alias("min_id"), F.col(f"max_{c}").cast("long").alias("max_id"), F.col(f"d_{c}").alias("n_distinct")) for c in ids))
    return stats.select(F.inline(parts)).withColumn("dense", (F.col("n_rows") == F.col("n_distinct")) & (F.col("min_id") == 0) & (F.col("max_id") == F.col("n_rows") - 1))


def schema_summary(df: DataFrame) -> DataFrame:
    """(ordinal, name, type, nullable), a row a column."""
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)], "ordinal int, name string, type string, nullable boolean")


def audit(df: DataFrame, source: str, expected_sources: int, expected_rows: DataFrame) -> DataFrame:
    """(source, n, expected, warning): rows of each source against expected_rows (source, expected); warning where they differ.

    Another number of sources than expected is an error.
    """
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    if (have := counts.count()) != expected_sources:
        raise ConstraintError(f"{have} sources, not {expected_sources}")
    out = counts.join(expected_rows, source, "left")
    return out.select(source, "n", "expected", (~F.col("n").eqNullSafe(F.col("expected"))).alias("warning"))


def batch_problems(configs: DataFrame) -> DataFrame:
    """(dataset, problem), a row for each rule that a dataset's settings break.

    configs: (dataset, sample_factor, sample_size, group_size). A negative sample_size means none is set; a factor of 1 neither.
    """
    rules = {
        "the factor must be positive": "sample_factor <= 0",
        "both a size and a factor": "sample_size >= 0 AND sample_factor <> 1",
        "a group needs two passages": "group_size < 2",
    }
    found = F.array_compact(F.array(*(F.when(F.expr(c), n) for n, c in rules.items())))
    return configs.select("dataset", F.explode(found).alias("problem"))


def record_problems(rows: DataFrame, key: str, positives: str, negatives: str) -> DataFrame:
    """(key, problem) of records with a missing or empty list of positives or of negatives."""
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    found = F.array_compact(F.array(F.when(empty(positives), "no positive passages"), F.when(empty(negatives), "no negative passages")))
    return rows.select(key, F.explode(found).alias("problem"))


def manifest_problems(manifests: DataFrame, version: int, dataset: str, revision: str) -> DataFrame:
    """manifests (format_version, source_dataset, source_revision, ...) that aren't of this format, dataset and revision, with problem."""
    wrong = lambda c, want: ~F.col(c).eqNullSafe(F.lit(want))
    problem = F.when(wrong("format_version", version), "format version").when(wrong("source_dataset", dataset), "dataset").when(wrong("source_revision", revision), "revision")
    return manifests.withColumn("problem", problem).where("problem IS NOT NULL")


def assert_manifest(manifests: DataFrame, version: int, dataset: str, revision: str) -> DataFrame:
    """manifests, after none of them is of another format, dataset or revision."""
    assert_empty(manifest_problems(manifests, version, dataset, revision), "manifest")
    return manifests
