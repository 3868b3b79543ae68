"""Telemetry as Structured Streaming: windowed aggregates, consumed-only accounting and attempt upserts.

Event times without a zone are read as TIMESTAMP_NTZ, which watermarks don't take: they are cast, and cast back in results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import own_dir
from quern.sources import attempts

WINDOW, LATENESS = "1 hour", "10 minutes"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream, with ts as TIMESTAMP."""
    schema = spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    out = src.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else src.parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).isDirectory()


def windowed(events: DataFrame) -> DataFrame:
    """(window_start, event_type, n, total) by tumbling window."""
    g = events.withWatermark("ts", LATENESS).groupBy(F.window("ts", WINDOW), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


def consumed(events: DataFrame, epoch: str) -> DataFrame:
    """Events of the current epoch, each id once however often it is delivered within the watermark."""
    return events.where(epoch).withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Drain an available-now stream; its appended rows (or last complete result) as a table in the shared folder.

    In append mode a window is written once, when the watermark has passed its end, and its state is dropped then. Each
    micro-batch writes a folder of its own, so one that is repeated after a failure replaces itself. Given the base of an
    earlier run, the stream goes on where that one ended.
    """
    spark = stream.sparkSession
    base = base or f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/{'complete' if mode == 'complete' else f'epoch={epoch}'}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def upsert_latest(stream: DataFrame, key: str, seq: str, base: str | None = None) -> DataFrame:
    """The latest row of each key after the stream.

    A micro-batch appends its own latest rows to a log under its number; every FOLD of them the log is folded into one part.
    Nothing is kept in memory, so a stream that is started again on the same base goes on with all earlier rows.
    """
    spark = stream.sparkSession
    base = base or f"{own_dir(spark)}/upsert-{uuid.uuid4().hex}"
    log, schema = f"{base}/log", stream.schema

    def merge(df: DataFrame, epoch: int) -> None:
        attempts.append(log, attempts.latest(df, key, seq), f"epoch{epoch}")
        if epoch % attempts.FOLD == attempts.FOLD - 1:
            attempts.fold(spark, log, schema, key, seq, epoch)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return attempts.latest(attempts.read(spark, log, schema), key, seq)


def smoothed(stream: DataFrame, run: str, order: str, value: str, alpha: float, event_time: str | None = None, idle: float = 86_400.0) -> DataFrame:
    """(run, n, ema) after each micro-batch: exponential smoothing whose state is a count and a number for each run.

    Values of a micro-batch are taken in order; a later batch must hold later ones. With event_time, a run's state is dropped
    once the watermark is idle seconds past its last event, so the store holds live runs alone; a run that comes back after
    that begins anew. Without it state is kept for good, for runs whose number is bounded.
    """
    kind = stream.schema[run].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, ema, last = state.get if state.exists else (0, 0.0, 0)
        rows = pd.concat(list(parts)).sort_values(order)
        for x in rows[value]:
            ema = x if n == 0 else alpha * x + (1 - alpha) * ema
            n += 1
        if event_time:
            last = max(last, int(rows[event_time].max().timestamp() * 1000))
            state.update((n, float(ema), last))
            state.setTimeoutTimestamp(max(last + int(1000 * idle), state.getCurrentWatermarkMs() + 1))
        else:
            state.update((n, float(ema), last))
        yield pd.DataFrame({run: [key[0]], "n": [n], "ema": [float(ema)]})

    if event_time:
        stream = stream.withWatermark(event_time, LATENESS)
    timeout = GroupStateTimeout.EventTimeTimeout if event_time else GroupStateTimeout.NoTimeout
    return stream.groupBy(run).applyInPandasWithState(step, f"`{run}` {kind}, n long, ema double", "n long, ema double, last long", "update", timeout)


def open_units(stream: DataFrame, worker: str, order: str, unit: str, capacity: int) -> DataFrame:
    """(worker, order, opened, evicted): for each worker's schedule, the units that it has to open, and which it closes for them.

    A worker holds capacity units at most and closes the one least recently used; its state is their list.
    """
    if capacity <= 0:
        raise ValueError("the capacity must be positive")
    kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in (worker, order))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict.fromkeys(state.get[0]) if state.exists else {}
        rows = []
        for at, u in pd.concat(list(parts)).sort_values(order)[[order, unit]].itertuples(index=False):
            known = u in held
            held.pop(u, None)
            gone = next(iter(held)) if not known and len(held) >= capacity else None
            held.pop(gone, None)
            held[u] = None
            if not known:
                rows.append((key[0], at, u, gone))
        state.update((list(held),))
        yield pd.DataFrame(rows, columns=[worker, order, "opened", "evicted"])

    return stream.groupBy(worker).applyInPandasWithState(step, f"{kinds}, opened string, evicted string", "held array<string>", "append", GroupStateTimeout.NoTimeout)
