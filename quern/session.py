"""Session settings and shared-storage helpers used across the engine."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RANGE_BYTES = 512 << 20
_local_dir: list[str] = []
_scopes = threading.local()  # .open: for each open block of temporary_tables, the paths written in it

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the engine's defaults; a cluster passes its own master and sizes."""
    b = SparkSession.builder.master(master).appName("quern")
    for k, v in (DEFAULT_CONF | {"spark.sql.shuffle.partitions": str(partitions)} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one in local mode (tests).

    On a cluster that names none it is an error, as other machines could not read a folder of the driver's.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="quern-"))
        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return f"file://{_local_dir[0]}"


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    return f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Delete the tables that this application has written in the shared folder; results that read them are gone then."""
    delete(spark, own_dir(spark))


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written in the block are deleted at its end, but for those given to the function that it yields.

    What is kept, and whatever else outlives the block, must not read the others.
    """
    scopes = _scopes.__dict__.setdefault("open", [])
    scopes.append(written := set())

    def keep(df: DataFrame) -> DataFrame:
        written.discard(df._table_path)
        for outer in scopes[-2:-1]:
            outer.add(df._table_path)
        return df

    try:
        yield keep
    finally:
        scopes.pop()
        for path in written:
            delete(spark, path)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and broadcasts of earlier results that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block; whatever was set before is set again after it."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialise(df: DataFrame, label: str = "t", compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and lost executors cost nothing.

    The shuffle files of the finished step are deleted with it.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", compression).parquet(path)
    return written_table(spark, path, df.schema)


def written_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A table of own_dir, which belongs to the block of temporary_tables that is open."""
    out = spark.read.schema(schema).parquet(path)
    out._table_path = path
    for written in _scopes.__dict__.get("open", [])[-1:]:
        written.add(path)
    return out


def as_written(df: DataFrame) -> DataFrame:
    """The rows of df in the order in which its table was written: by number of file, then by place in it.

    Readers deal files by size, whatever their order. What is not read from files of one Parquet table stays as it is. Columns
    may have any name that doesn't begin with __.
    """
    try:
        m = df.metadataColumn("_metadata")
        number = F.expr(r"try_cast(regexp_extract(__name, 'part-([0-9]+)', 1) AS long)")
        rows = df.withColumns({"__name": m["file_name"], "__at": m["row_index"]}).withColumn("__file", number)
        rows.schema  # noqa: B018
    except AnalysisException:
        return df
    order = [F.col("__file").asc_nulls_last(), F.col("__name"), F.col("__at")]
    return rows.repartitionByRange(ranges(df), *order).sortWithinPartitions(*order).select(*(f"`{c.replace('`', '``')}`" for c in df.columns))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Fewer rows in each Arrow batch than Spark's default: with long texts, batches are a worker's largest buffers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(df: DataFrame, most: int = RANGE_BYTES) -> int:
    """Into how many ranges to sort df: the session's shuffle partitions, or more where one would get over so many of the bytes read.

    What df reads is known from its plan, without a job; what isn't known there (rows of the driver, streams) counts nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(partitions(df.sparkSession), -(-sum(n for n in sizes if n < 1 << 62) // most))
