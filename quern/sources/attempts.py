"""A log of attempts: rows are only appended, each write a folder of its own, and views are computed from all of them.

Nothing is held in memory between writes, so a log goes on after a restart. Writers don't wait for each other: a write is
renamed into place under its own name, and one that is repeated under the same name replaces itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.sources.records import hadoop_path, publish

FOLD = 64


def append(log: str, rows: DataFrame, name: str | None = None) -> None:
    """Add rows under a name (by default a new one)."""
    publish(rows, f"{log}/part={name or uuid.uuid4().hex}", replace=name is not None)


def read(spark: SparkSession, log: str, schema: StructType) -> DataFrame:
    """All rows of the log; an empty table if there is none."""
    p, fs = hadoop_path(spark, log)
    parts = [x.getPath() for x in fs.listStatus(p)] if fs.exists(p) else []
    names = [x.toString() for x in parts if x.getName().startswith("part=") and "." not in x.getName()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the highest seq of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), seq).alias("r")).select("r.*")


def fold(spark: SparkSession, log: str, schema: StructType, key: str, seq: str, epoch: int) -> None:
    """Replace the epochs up to this one by their latest rows, in one part: views stay the same and reads stay short."""
    latest_rows = latest(read(spark, log, schema), key, seq)
    p, fs = hadoop_path(spark, log)
    old = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName().startswith("part=")]
    publish(latest_rows, f"{log}/part=folded{epoch}", replace=True)
    for x in old:
        if x.getName() != f"part=folded{epoch}":
            fs.delete(x, True)
