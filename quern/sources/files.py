"""File formats that Spark lacks, read and written in tasks: Arrow record batches, index archives, tensor files, file digests.

Tasks open files through pyarrow's file systems, so paths must be in a store that these know.
"""

from __future__ import annotations

import hashlib
import io
import json
import math
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.operators.checks import ConstraintError, assert_empty, assert_schema
from quern.operators.corpus import dense_ids
from quern.session import materialise, setting
from quern.sources.records import hadoop_path

CHUNK_BYTES, BATCH_ROWS, RUN_BATCHES, SEGMENT, SHARD_BYTES, SPLIT_BYTES = 4 << 20, 4096, 64, 1 << 20, 1 << 30, 4 << 20


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """pyarrow's file system and path of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_text(path: str) -> str:
    store, p = opened(path)
    with store.open_input_stream(p) as f:
        return f.read().decode()


def write_bytes(path: str, data: bytes) -> None:
    """A small file under a name of its own, moved into place, so a repeated or parallel attempt leaves one whole file."""
    store, p = opened(path)
    staged = f"{p.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with store.open_output_stream(staged) as f:
        f.write(data)
    store.move(staged, p)


# ---------------------------------------------------------------- digests of files


def file_digest(path: str) -> tuple[int, str]:
    """Size and SHA-256 of a file, read in chunks."""
    store, p = opened(path)
    h, n = hashlib.sha256(), 0
    with store.open_input_stream(p) as f:
        while chunk := f.read(CHUNK_BYTES):
            h.update(chunk)
            n += len(chunk)
    return n, h.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [file_digest(u) for u in b.column("uri").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("file"), pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], pa.string())], names=["file", "size", "sha256"])


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size, sha256) of the files below a folder, by their path in it; hidden ones are left out. Each is read in one task."""
    p, fs = hadoop_path(spark, folder)
    root = fs.makeQualified(p).toString().rstrip("/")
    it, found = fs.listFiles(p, True), []
    while it.hasNext():
        uri = it.next().getPath().toString()
        name = uri[len(root) + 1 :]
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            found.append((name, uri))
    listed = spark.createDataFrame(sorted(found), "file string, uri string").repartition(max(1, min(len(found), 200)), "file")
    return listed.mapInArrow(_digests, "file string, size long, sha256 string")


def seal(spark: SparkSession, folder: str) -> None:
    """Write the manifest of a folder's files beside them (_manifest, which readers of tables pass over)."""
    file_digests(spark, folder).coalesce(1).write.mode("errorifexists").json(f"{folder}/_manifest")


def seal_problems(spark: SparkSession, folder: str) -> DataFrame:
    """(file, problem) where a folder differs from its manifest: missing, unknown, size or changed."""
    want = spark.read.schema("file string, size long, sha256 string").json(f"{folder}/_manifest")
    have = file_digests(spark, folder).select("file", F.col("size").alias("size_now"), F.col("sha256").alias("sha256_now"))
    j = want.join(have, "file", "full_outer")
    problem = F.when(F.col("size_now").isNull(), "missing").when(F.col("size").isNull(), "unknown").when(F.col("size") != F.col("size_now"), "size").when(F.col("sha256") != F.col("sha256_now"), "changed")
    return j.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def publish_sealed(df: DataFrame, path: str, records_per_file: int = 0, compression: str = "zstd") -> None:
    """A Parquet table that comes up under its path at once, together with the manifest of its files' digests."""
    spark = df.sparkSession
    target, fs = hadoop_path(spark, path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        w = df.write.mode("errorifexists").option("compression", compression)
        (w.option("maxRecordsPerFile", records_per_file) if records_per_file else w).parquet(staged)
        seal(spark, staged)
        if fs.exists(target) or not fs.rename(hadoop_path(spark, staged)[0], target):
            raise OSError(f"can't publish {path}")
    finally:
        fs.delete(hadoop_path(spark, staged)[0], True)


def open_sealed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A sealed table, after its files are what they were when it was published; anything else is an error."""
    assert_empty(seal_problems(spark, path), path)
    return assert_schema(spark.read.parquet(path), schema, ordered=False).select(*schema.names)


# ---------------------------------------------------------------- Arrow record batch files


class _Hashed(io.RawIOBase):
    """Passes bytes on and keeps their digest and number."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.hash, self.n = out, hashlib.sha256(), 0

    def writable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.n

    def write(self, data: bytes) -> int:
        data = bytes(data)
        self.out.write(data)
        self.hash.update(data)
        self.n += len(data)
        return len(data)


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int
    batches: int
    size: int
    sha256: str


class _ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, rows: int, overwrite: bool):
        self.path, self.spark_schema, self.rows, self.overwrite = path, schema, rows, overwrite
        self.staged = f"{path}.staged-{uuid.uuid4().hex}"
        store, p = opened(path)
        if not overwrite and store.get_file_info(p).type.name != "NotFound":
            raise FileExistsError(path)
        store.create_dir(opened(self.staged)[1])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.arrow"
        schema, rows, batches, held = to_arrow_schema(self.spark_schema), 0, 0, []
        store, p = opened(f"{self.staged}/{name}")
        with store.open_output_stream(p) as raw:
            sink = _Hashed(raw)
            with pa.ipc.new_file(pa.PythonFile(sink, mode="w"), schema) as out:

                def put(least: int) -> None:
                    """Whole batches of what is held, so that only a file's last one is shorter."""
                    nonlocal held, batches, rows
                    table = pa.Table.from_batches(held, schema)
                    while table.num_rows >= least and table.num_rows:
                        part = table.slice(0, self.rows).combine_chunks().to_batches()[0]
                        out.write_batch(part)
                        batches, rows, table = batches + 1, rows + part.num_rows, table.slice(part.num_rows)
                    held = table.to_batches()

                for b in iterator:
                    held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema))
                    if sum(x.num_rows for x in held) >= self.rows:
                        put(self.rows)
                put(1)
        return _Written(name, rows, batches, sink.n, sink.hash.hexdigest())

    def commit(self, messages: list[_Written | None]) -> None:
        done = [m for m in messages if m is not None]
        store, staged = opened(self.staged)
        named = {m.file for m in done}
        for info in store.get_file_info(pa.fs.FileSelector(staged)):  # what attempts that didn't count have left
            if info.base_name not in named:
                store.delete_file(info.path)
        files = [m.__dict__ for m in sorted(done, key=lambda m: m.file) if m.rows]
        for m in done:
            if not m.rows:
                store.delete_file(f"{staged}/{m.file}")
        write_bytes(f"{self.staged}/_manifest.json", json.dumps({"schema": self.spark_schema.json(), "rows": sum(m.rows for m in done), "files": files}).encode())
        target = opened(self.path)[1]
        there = store.get_file_info(target).type.name != "NotFound"
        if there and not self.overwrite:
            self.abort([])
            raise FileExistsError(self.path)
        if there:
            store.delete_dir(target)
        store.move(staged, target)

    def abort(self, messages: list[_Written | None]) -> None:
        store, staged = opened(self.staged)
        if store.get_file_info(staged).type.name != "NotFound":
            store.delete_dir(staged)


@dataclass
class _Run(InputPartition):
    file: dict
    first: int
    stop: int


class _ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, verify: bool, run: int):
        self.path, self.spark_schema, self.verify, self.run = path, schema, verify, run
        self.manifest = json.loads(read_text(f"{path}/_manifest.json"))

    def partitions(self) -> list[_Run]:
        return [_Run(f, i, min(i + self.run, f["batches"])) for f in self.manifest["files"] for i in range(0, f["batches"], self.run)]

    def read(self, partition: _Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a table without batches
            return
        f = partition.file
        store, p = opened(f"{self.path}/{f['file']}")
        with store.open_input_file(p) as raw:
            if raw.size() != f["size"]:
                raise ConstraintError(f"{f['file']} has {raw.size()} bytes, not {f['size']}")
            if self.verify and partition.first == 0 and (now := file_digest(f"{self.path}/{f['file']}")[1]) != f["sha256"]:
                raise ConstraintError(f"{f['file']} has the digest {now}, not {f['sha256']}")
            want = to_arrow_schema(self.spark_schema)
            reader = pa.ipc.open_file(raw)
            if reader.num_record_batches != f["batches"]:
                raise ConstraintError(f"{f['file']} has {reader.num_record_batches} batches, not {f['batches']}")
            whole = to_arrow_schema(StructType.fromJson(json.loads(self.manifest["schema"])))
            if reader.schema.names != whole.names or reader.schema.types != whole.types:
                raise ConstraintError(f"{f['file']} has the schema {reader.schema}, not {whole}")
            for i in range(partition.first, partition.stop):
                b = reader.get_batch(i)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in want.names], schema=want)


class ArrowFiles(DataSource):
    """Tables as files of Arrow record batches of at most `rows` rows, with a manifest of sizes, batches and digests.

    spark.dataSource.register(ArrowFiles); then df.write.format("record_batches").mode("append" or "overwrite").save(path) and
    spark.read.format("record_batches").load(path). A table comes up whole by a rename; append to one that is there is an error.
    Each run of batches is a task. Size, number of batches and schema are checked when a file is opened, with the option
    verify its digest too; a schema given to the reader selects columns. The driver holds a line a file.
    """

    @classmethod
    def name(cls) -> str:
        return "record_batches"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(json.loads(read_text(f"{self.options['path']}/_manifest.json"))["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ArrowReader(self.options["path"], schema, self.options.get("verify", "false") == "true", int(self.options.get("run", RUN_BATCHES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ArrowWriter(self.options["path"], schema, int(self.options.get("rows", BATCH_ROWS)), overwrite)


def write_batches(df: DataFrame, path: str, rows: int = BATCH_ROWS, overwrite: bool = False) -> None:
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format("record_batches").option("rows", rows).mode("overwrite" if overwrite else "append").save(path)


def read_batches(spark: SparkSession, path: str, schema: str | StructType | None = None, verify: bool = False, run: int = RUN_BATCHES) -> DataFrame:
    spark.dataSource.register(ArrowFiles)
    r = spark.read.format("record_batches").option("verify", str(verify).lower()).option("run", run)
    return (r.schema(schema) if schema is not None else r).load(path)


# ---------------------------------------------------------------- index archives


def _archived(path: str) -> Callable[[pa.Table], pa.Table]:
    def write(t: pa.Table) -> pa.Table:
        shard, segment = t.column("shard")[0].as_py(), t.column("segment")[0].as_py()
        buffer = io.BytesIO()
        np.lib.format.write_array(buffer, np.sort(t.column("value").to_numpy()).astype("<i8"), version=(1, 0), allow_pickle=False)
        name = f"{shard.encode().hex() or '-'}.{segment:06d}.npy"
        write_bytes(f"{path}/{name}", buffer.getvalue())
        return pa.table({"file": [name], "shard": [shard], "segment": pa.array([segment], pa.int64()), "n": pa.array([t.num_rows], pa.int64()), "sha256": [hashlib.sha256(buffer.getvalue()).hexdigest()]})

    return write


def write_index_archive(df: DataFrame, shard: str, value: str, path: str, segment: int = SEGMENT) -> DataFrame:
    """Write each shard's values as sorted int64 arrays, a file for every segment of them; returns (file, shard, segment, n, sha256).

    Bytes depend on the values alone, not on partitions or time: segments are cut by rank, arrays have one layout, and names
    are the shard's bytes in hexadecimal. A large shard is many segments, each written in a task of its own. Nulls are left
    out; values that repeat stay.
    """
    store, p = opened(path)
    store.create_dir(p)
    rows = df.select(F.col(shard).cast("string").alias("shard"), F.col(value).cast("long").alias("value")).where("shard IS NOT NULL AND value IS NOT NULL")
    ranked = dense_ids(rows, ["value"], "at", ["shard"]).select("shard", "value", F.expr(f"at div {segment}").alias("segment"))
    written = ranked.groupBy("shard", "segment").applyInArrow(_archived(path), "file string, shard string, segment long, n long, sha256 string")
    return materialise(written, "archived")


def _loaded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                store, p = opened(f"{path}/{name}")
                with store.open_input_stream(p) as f:
                    values = np.lib.format.read_array(io.BytesIO(f.read()), allow_pickle=False)
                shard = bytes.fromhex(name.split(".")[0].strip("-")).decode()
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(values), pa.string()), pa.array(values)], names=["shard", "value"])

    return read


def read_index_archive(spark: SparkSession, path: str) -> DataFrame:
    """(shard, value) of an archive, a file at a time in tasks."""
    store, p = opened(path)
    names = sorted(i.base_name for i in store.get_file_info(pa.fs.FileSelector(p)) if i.base_name.endswith(".npy") and not i.base_name.startswith("."))
    listed = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, min(len(names), 200)), "file")
    return listed.mapInArrow(_loaded(path), "shard string, value long")


# ---------------------------------------------------------------- tensor files

# The format's names of number types.
_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "<u1"}


def tensor_header(path: str) -> tuple[list[tuple[str, str, list[int], int, int]], int]:
    """(name, type, shape, first byte, past-last byte) of each tensor of a file, and where its data begins; all is checked."""
    store, p = opened(path)
    with store.open_input_file(p) as f:
        size = f.size()
        if size < 8 or (n := struct.unpack("<Q", f.read(8))[0]) > size - 8:
            raise ConstraintError(f"{path} is no tensor file")
        header = json.loads(f.read(n))
    header.pop("__metadata__", None)
    out = sorted(((name, h["dtype"], h["shape"], *h["data_offsets"]) for name, h in header.items()), key=lambda t: (t[3], t[4]))
    at = 0
    for name, kind, shape, begin, end in out:
        if kind not in _TYPES:
            raise ConstraintError(f"{name} has the unknown type {kind}")
        if begin != at or end - begin != math.prod(shape) * np.dtype(_TYPES[kind]).itemsize:
            raise ConstraintError(f"{name} has wrong offsets")
        at = end
    if size != 8 + n + at:
        raise ConstraintError(f"{path} has {size} bytes, not {8 + n + at}")
    return out, 8 + n


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri, key, kind, cols, first, begin, count in zip(*(b.column(c).to_pylist() for c in ("uri", "key", "kind", "cols", "first", "begin", "count"))):
            store, p = opened(uri)
            with store.open_input_file(p) as f:
                x = np.frombuffer(f.read_at(count * np.dtype(_TYPES[kind]).itemsize, begin), _TYPES[kind])
            if kind == "BF16":
                x = (x.astype("<u4") << 16).view("<f4")
            at = first + np.arange(count)
            yield pa.RecordBatch.from_arrays([pa.array([key] * count, pa.string()), pa.array(at // cols), pa.array(at % cols), pa.array(x.astype(np.float64))], names=["key", "i", "j", "x"])


def read_tensors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(key, i, j, x) of tensor files (safetensors): headers are read and checked by the driver, data in ranges of SPLIT_BYTES by tasks.

    Tensors of more than two dimensions have the last one as j; a vector is one row, a number one value.
    """
    rows = []
    for path in [paths] if isinstance(paths, str) else paths:
        tensors, base = tensor_header(path)
        for name, kind, shape, begin, _ in tensors:
            rows.append((path, name, kind, math.prod(shape), max(1, shape[-1] if shape else 1), base + begin, np.dtype(_TYPES[kind]).itemsize))
    t = spark.createDataFrame(rows, "uri string, key string, kind string, n long, cols long, at long, width int").where("n > 0")
    step = F.lit(SPLIT_BYTES) / F.col("width")
    t = t.withColumn("step", step.cast("long")).withColumn("first", F.explode(F.expr("sequence(0L, n - 1, step)")))
    t = t.select("uri", "key", "kind", "cols", "first", (F.col("at") + F.col("first") * F.col("width")).alias("begin"), F.least("step", F.col("n") - F.col("first")).alias("count"))
    return t.repartition(max(1, min(len(rows), 200)), "uri", "key", "first").mapInArrow(_ranges, "key string, i long, j long, x double")


def _chunk(kind: str) -> Callable[[pa.Table], pa.Table]:
    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        x = t.column("x").to_numpy()
        data = (x.astype("<f4").view("<u4") >> 16).astype("<u2") if kind == "BF16" else x.astype(_TYPES[kind])
        return pa.table({"file": t.column("file").slice(0, 1), "place": t.column("place").slice(0, 1), "chunk": t.column("chunk").slice(0, 1), "data": pa.array([data.tobytes()], pa.binary())})

    return pack


def _tensor_writer(path: str, headers: dict[int, tuple[str, bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, staged = None, None, ""
        store = opened(path)[0]

        def close() -> pa.RecordBatch:
            out.close()
            store.move(staged, opened(f"{path}/{headers[now][0]}")[1])
            return pa.RecordBatch.from_arrays([pa.array([headers[now][0]])], names=["file"])

        for b in batches:
            for number, data in zip(b.column("file").to_pylist(), b.column("data").to_pylist()):
                if number != now:
                    if out is not None:
                        yield close()
                    now, staged = number, opened(f"{path}/.{uuid.uuid4().hex}")[1]
                    out = store.open_output_stream(staged)
                    out.write(struct.pack("<Q", len(headers[now][1])) + headers[now][1])
                out.write(data)
        if out is not None:
            yield close()

    return write


def write_tensors(tensors: DataFrame, path: str, kind: str = "F32", shard_bytes: int = SHARD_BYTES) -> list[str]:
    """Write (key, i, j, x) as tensor files of shard_bytes at most (or one larger tensor each); returns their names.

    Every tensor must be whole: each of rows x cols places once. Values are packed in chunks, dealt out by file and written
    in order, so a task holds a few chunks. The driver holds a header, which is a line a tensor.
    """
    spark, width = tensors.sparkSession, np.dtype(_TYPES[kind]).itemsize
    store, p = opened(path)
    store.create_dir(p)
    shapes = tensors.groupBy("key").agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"), F.count(F.lit(1)).alias("n"), F.countDistinct("i", "j").alias("places")).orderBy("key").collect()
    if bad := [r["key"] for r in shapes if not r["n"] == r["places"] == r["rows"] * r["cols"]]:
        raise ConstraintError(f"tensors that aren't whole: {bad[:10]}")
    files, placed = [], []
    for r in shapes:
        size = r["n"] * width
        if not files or files[-1][1] + size > shard_bytes:
            files.append([{}, 0])
        header, at = files[-1]
        header[r["key"]] = {"dtype": kind, "shape": [r["rows"], r["cols"]], "data_offsets": [at, at + size]}
        placed.append((r["key"], r["cols"], len(files) - 1, len(header) - 1))
        files[-1][1] += size
    names = [f"model-{k + 1:05d}-of-{len(files):05d}.safetensors" for k in range(len(files))]
    headers = {}
    for k, (header, _) in enumerate(files):
        text = json.dumps(header, separators=(",", ":")).encode()
        headers[k] = (names[k], text + b" " * (-len(text) % 8))
    where = spark.createDataFrame(placed, "key string, cols long, file int, place int")
    flat = tensors.join(where, "key").select("file", "place", (F.col("i") * F.col("cols") + F.col("j")).alias("at"), "x").withColumn("chunk", F.expr(f"at div {CHUNK_BYTES // 8}"))
    chunks = materialise(flat.groupBy("file", "place", "chunk").applyInArrow(_chunk(kind), "file int, place int, chunk long, data binary"), "chunks")
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "4"):
        dealt = chunks.repartition(max(1, min(len(files), 1000)), "file").sortWithinPartitions("file", "place", "chunk")
        done = dealt.mapInArrow(_tensor_writer(path, headers), "file string").count()
    if done != len(files):
        raise ConstraintError(f"{done} files written, not {len(files)}")
    write_bytes(f"{path}/model.safetensors.index.json", json.dumps({"weight_map": {key: names[f] for key, _, f, _ in placed}}, sort_keys=True).encode())
    return names
