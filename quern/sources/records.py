"""Sources and sinks: record files, positional rows, file inventories, manifests, published tables and reports."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quern.functions.hashing import canonical_json
from quern.operators.checks import ConstraintError, assert_count, assert_schema
from quern.operators.corpus import dense_ids
from quern.session import materialise, own_dir

FOOTER_TASKS, GROUP_BYTES = 200, 64 << 20

RECORD = "query STRING, pos ARRAY<STRING>, neg ARRAY<STRING>, prompt STRING, type STRING, pos_scores ARRAY<DOUBLE>, neg_scores ARRAY<DOUBLE>"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, on the driver; works for every store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files below a folder, recursively, in sorted order; hidden ones are left out."""
    p, fs = hadoop_path(spark, path)
    it, out = fs.listFiles(p, True), []
    while it.hasNext():
        s = it.next().getPath()
        if s.getName().endswith(suffixes) and not s.getName().startswith(("_", ".")):
            out.append(s.toString())
    return sorted(out)


def read_records(spark: SparkSession, path: str, schema: str | StructType = RECORD) -> DataFrame:
    """JSON lines (.jsonl) or JSON lists (.json); a folder is the union of its files. Malformed records are errors."""
    files = [path] if path.endswith((".json", ".jsonl")) else list_files(spark, path, (".json", ".jsonl"))
    if not files:
        raise ValueError(f"no .json or .jsonl file in {path}")
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    lines, lists = [f for f in files if f.endswith(".jsonl")], [f for f in files if f.endswith(".json")]
    parts = ([reader.json(lines)] if lines else []) + ([reader.option("multiLine", True).json(lists)] if lists else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, ordinal, value) of the lines of text files: line counts from 0 in its file, ordinal over all files in sorted order.

    Files are read in splits, twice: the first time each split's lines are counted, and the counts of those before it number
    its own, so one large file is many tasks. Compressed files are one split each.
    """
    m = F.col("_metadata")
    lines = spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__id"))
    splits = lines.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    order = Window.orderBy("file", "__block")  # a row a split
    splits = splits.withColumn("__all", F.sum("__n").over(order) - F.col("__n")).withColumn("__own", F.sum("__n").over(Window.partitionBy("file").orderBy("__block")) - F.col("__n"))
    place = F.col("__id") - F.col("__first")
    return lines.join(splits, ["file", "__block"]).select("file", (F.col("__own") + place).alias("line"), (F.col("__all") + place).alias("ordinal"), "value")


def numbered_records(spark: SparkSession, path: str | list[str], schema: str | StructType = RECORD) -> DataFrame:
    """JSON lines with ordinal, their number over all files in sorted order, blank lines not counted; malformed ones are errors."""
    lines = numbered_lines(spark, path)
    full = lines.where("trim(value) <> ''")
    if lines.where("trim(value) = ''").limit(1).count():
        full = dense_ids(full.select("ordinal", "value"), ["ordinal"], "__o").select(F.col("__o").alias("ordinal"), "value")
    return full.select("ordinal", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("ordinal", "r.*")


def capped_lines(spark: SparkSession, path: str | list[str], most: int) -> DataFrame:
    """The first so many lines of each file, as numbered_lines has them."""
    return numbered_lines(spark, path).where(F.col("line") < most)


def selected_groups(spark: SparkSession, paths: str | list[str], index: DataFrame, columns: list[str]) -> DataFrame:
    """(uri, file_name, row_group, first_row, bytes, rows) of the row groups that hold the rows of an index (file_name, row_index).

    bytes are the compressed bytes of the columns in the group; rows the sorted places inside it, each once. Footers alone are
    read. A file that isn't among the paths, or whose name occurs twice there, and a place beyond a file's end are errors.
    """
    files = inventory(spark, paths).select("uri", F.col("path").alias("__file"), "row_group_rows", "column_bytes")
    files = materialise(files, "footers")
    if twice := files.groupBy("__file").count().where("count > 1").limit(10).collect():
        raise ValueError(f"several files of one name: {[r['__file'] for r in twice]}")
    wanted = index.select("file_name", F.col("row_index").cast("long").alias("row_index"))
    j = wanted.join(files.select("__file", "uri", "row_group_rows"), F.col("file_name") == F.col("__file"), "left")
    # running ends of a file's row groups; a row lies in the first group that ends after it
    ends = F.transform(F.sequence(F.lit(1), F.size("row_group_rows")), lambda k: F.aggregate(F.slice("row_group_rows", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x))
    ends = F.when(F.size("row_group_rows") > 0, ends).otherwise(F.array().cast("array<long>"))
    located = files.select(F.col("__file"), F.posexplode(F.arrays_zip(ends.alias("stop"), F.col("row_group_rows").alias("size"))).alias("row_group", "g"))
    located = located.select("__file", "row_group", F.col("g.stop").alias("stop"), (F.col("g.stop") - F.col("g.size")).alias("first_row"))
    total = F.aggregate("row_group_rows", F.lit(0).cast("long"), lambda a, x: a + x)
    bad = F.col("uri").isNull() | F.col("row_index").isNull() | (F.col("row_index") < 0) | (F.col("row_index") >= total)
    if missing := j.where(F.coalesce(bad, F.lit(True))).select("file_name", "row_index").limit(10).collect():
        raise ConstraintError(f"no such row: {[tuple(r) for r in missing]}")
    checked = j.select("file_name", "uri", "row_index")
    near = checked.join(located, (F.col("file_name") == F.col("__file")) & (F.col("row_index") < F.col("stop")) & (F.col("row_index") >= F.col("first_row")))
    grouped = near.groupBy("uri", "file_name", "row_group", "first_row").agg(F.sort_array(F.collect_set(F.col("row_index") - F.col("first_row"))).alias("rows"))
    cost = files.select(F.col("uri").alias("__uri"), "column_bytes")
    size = F.aggregate(F.array(*(F.coalesce(F.get(F.col("column_bytes")[c], F.col("row_group")), F.lit(0).cast("long")) for c in columns)) if columns else F.array().cast("array<long>"), F.lit(0).cast("long"), lambda a, x: a + x)
    return grouped.join(cost, F.col("uri") == F.col("__uri")).select("uri", "file_name", "row_group", "first_row", size.alias("bytes"), "rows")


def _read_groups(batches: Iterator[pa.RecordBatch], columns: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of the given row groups, a batch at a time: nothing else of a file is read."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for b in batches:
        for uri, name, group, first, rows in zip(*(b.column(c).to_pylist() for c in ("uri", "file_name", "row_group", "first_row", "rows"))):
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as handle:
                places, before = np.array(rows, np.int64), 0
                for part in pq.ParquetFile(handle).iter_batches(row_groups=[group], columns=columns or None):
                    inside = places[(places >= before) & (places < before + part.num_rows)]
                    if len(inside):
                        own = part.take(pa.array(inside - before))
                        found = [own.column(own.schema.get_field_index(f.name)).cast(f.type) for f in schema if f.name in columns]
                        yield pa.RecordBatch.from_arrays([*found, pa.array([name] * len(inside), pa.string()), pa.array(first + inside)], schema=schema)
                    before += part.num_rows


def read_selected(spark: SparkSession, paths: str | list[str], index: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, file_name, row_index): rows of Parquet files by position; index has file_name and row_index.

    Only the columns of those row groups that hold a wanted row are read, one group a task at a time and in batches, so the
    bytes read follow the selection (selected_groups tells them beforehand). A row that an index names several times comes
    once; a file or row that isn't there is an error. Where pyarrow doesn't know the store, files are scanned by Spark and
    joined with the index.
    """
    files = [paths] if isinstance(paths, str) else paths
    table = spark.read.parquet(*files)
    if not known_store(spark, files[0]):
        rows = table.select(*columns, F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
        return rows.join(index, ["file_name", "row_index"], "left_semi")
    schema = StructType([*(table.schema[c] for c in columns), StructField("file_name", StringType()), StructField("row_index", LongType())])
    groups = materialise(selected_groups(spark, paths, index, columns), "groups")
    # a row group is the unit of work; groups are dealt by their bytes
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    dealt = groups.repartition(max(1, min(groups.count(), -(-total // GROUP_BYTES))), "uri", "row_group")
    arrow = to_arrow_schema(schema)
    return dealt.mapInArrow(lambda it: _read_groups(it, columns, arrow), schema)


def known_store(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open a path's store by pyarrow."""
    from pyarrow import fs

    p, store = hadoop_path(spark, path)
    uri = store.makeQualified(p).toString()
    try:
        fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    except (pa.ArrowInvalid, OSError):
        return False
    return True


def first_rows(spark: SparkSession, path: str) -> DataFrame:
    """The first row of each file; the filter on the position keeps other row groups from being decoded."""
    return spark.read.parquet(path).where("_metadata.row_index = 0")


def _footer(path: str, handle) -> tuple:
    """What a Parquet footer says of its file, with a digest of the schema and one of all of it."""
    import pyarrow.parquet as pq

    f = pq.ParquetFile(handle)
    meta = f.metadata
    groups = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    schema = [{"name": x.name, "type": str(x.type), "nullable": x.nullable} for x in f.schema_arrow]
    size = handle.size()
    digest = lambda x: hashlib.sha256(canonical_json(x).encode()).hexdigest()
    whole = {"path": path, "size": size, "n_rows": meta.num_rows, "row_group_rows": groups, "schema": schema, "created_by": meta.created_by}
    sizes: dict[str, list[int]] = {}
    for i in range(meta.num_row_groups):
        own: dict[str, int] = {}
        for j in range(meta.row_group(i).num_columns):
            c = meta.row_group(i).column(j)
            top = c.path_in_schema.split(".")[0]
            own[top] = own.get(top, 0) + c.total_compressed_size
        for name, n in own.items():
            sizes.setdefault(name, [0] * i).append(n)
    return path, size, meta.num_rows, len(groups), groups, meta.created_by, json.dumps(schema), digest(schema), digest(whole), list(sizes.items())


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for b in batches:
        rows = []
        for uri in b.column(0).to_pylist():
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as handle:
                rows.append((uri, *_footer(uri.rpartition("/")[2], handle)))
        yield pa.RecordBatch.from_pylist([dict(zip(_INVENTORY.names, r)) for r in rows], schema=_INVENTORY)


_INVENTORY = pa.schema([("uri", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("n_rows", pa.int64()), ("row_groups", pa.int32()), ("row_group_rows", pa.list_(pa.int64())), ("created_by", pa.string()), ("schema", pa.string()), ("schema_fingerprint", pa.string()), ("metadata_fingerprint", pa.string()), ("column_bytes", pa.map_(pa.string(), pa.list_(pa.int64())))])
_INVENTORY_DDL = "uri string, path string, size long, n_rows long, row_groups int, row_group_rows array<long>, created_by string, schema string, schema_fingerprint string, metadata_fingerprint string, column_bytes map<string,array<long>>"


class _HadoopFile:
    """A file of a store that only Spark's own file systems can open, for reading its footer on the driver."""

    def __init__(self, spark: SparkSession, path: str):
        p, fs = hadoop_path(spark, path)
        self.length, self.stream, self.at, self.closed = fs.getFileStatus(p).getLen(), fs.open(p), 0, False
        self.jvm = spark._jvm

    def size(self) -> int:
        return self.length

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.length)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        n = self.length - self.at if n < 0 else min(n, self.length - self.at)
        self.stream.seek(self.at)
        out = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.stream, n)) if n else b""
        self.at += len(out)
        return out

    def close(self) -> None:
        self.closed = True
        self.stream.close()


def inventory(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(uri, path, size, n_rows, row_groups, row_group_rows, created_by, schema, schema_fingerprint, metadata_fingerprint,
    column_bytes: compressed bytes of each column by row group) of the Parquet files of a folder, or of listed files, from footers alone; no data page is read.

    Footers are read in tasks, each file once. Where pyarrow doesn't know the store, the driver reads them.
    """
    from pyarrow import fs

    files = []
    for x in [path] if isinstance(path, str) else path:
        p, store = hadoop_path(spark, x)
        files += [store.makeQualified(p).toString()] if store.getFileStatus(p).isFile() else list_files(spark, x, (".parquet",))
    uris = ["file://" + f.removeprefix("file:") if f.startswith("file:/") and not f.startswith("file://") else f for f in files]
    try:
        if uris:
            fs.FileSystem.from_uri(uris[0])
    except (pa.ArrowInvalid, OSError):
        rows = []
        for f in files:
            handle = _HadoopFile(spark, f)
            *found, sizes = _footer(f.rpartition("/")[2], handle)
            rows.append((f, *found, dict(sizes)))
            handle.close()
        return spark.createDataFrame(rows, _INVENTORY_DDL)
    listed = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, min(len(uris), FOOTER_TASKS)))
    return listed.mapInArrow(_footers, _INVENTORY_DDL)


def publish(df: DataFrame, path: str, records_per_file: int = 0, compression: str = "zstd", replace: bool = False) -> None:
    """Write beside the target and rename, so readers see all or nothing.

    An existing target is an error, or with replace it is set aside, and deleted once the new one is in its place; if that
    fails it is put back. Whatever fails, what was staged is deleted.
    """
    spark = df.sparkSession
    target, fs = hadoop_path(spark, path)
    if not replace and fs.exists(target):
        raise FileExistsError(path)
    mark = uuid.uuid4().hex
    staged, backup = hadoop_path(spark, f"{path}.staged-{mark}")[0], hadoop_path(spark, f"{path}.old-{mark}")[0]
    try:
        w = df.write.mode("errorifexists").option("compression", compression)
        (w.option("maxRecordsPerFile", records_per_file) if records_per_file else w).parquet(staged.toString())
        aside = fs.exists(target)
        if aside and not (replace and fs.rename(target, backup)):
            raise FileExistsError(path)
        if not _renamed(fs, staged, target):
            if aside:
                fs.rename(backup, target)
            raise OSError(f"can't publish {path}")
        if aside:
            fs.delete(backup, True)
    finally:
        fs.delete(staged, True)


def _renamed(fs, source, target) -> bool:
    """Whether source is now target; a target that has come up meanwhile isn't renamed into."""
    return not fs.exists(target) and fs.rename(source, target)


def open_table(spark: SparkSession, path: str, schema: StructType, rows: int | None = None) -> DataFrame:
    """A published table with its schema and count checked."""
    df = assert_schema(spark.read.parquet(path), schema, ordered=False).select(*schema.names)
    return assert_count(df, rows) if rows is not None else df


def read_results(spark: SparkSession, path: str, schema: str, task: str = r"([^/]*)\.json$", names: str = "*.json") -> DataFrame:
    """(task, file, result, problem): result documents, one a file, parsed with the schema; task is the first group of a pattern over the file's path.

    A document that doesn't parse has a null result and the problem corrupt, and none stops the others; an empty file gives no row.
    """
    raw = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", names).option("recursiveFileLookup", True).load(path)
    j = F.from_json("value", f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), task, 1).alias("task"), F.col("_metadata.file_path").alias("file"), j.alias("j"))
    bad = F.col("j.__corrupt").isNotNull() | F.col("j").isNull()
    return rows.select("task", "file", F.when(~bad, F.col("j").dropFields("__corrupt")).alias("result"), F.when(bad, "corrupt").alias("problem"))


def expected_results(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results (task, result, problem) of all expected tasks (task), with the problems missing, repeated and unexpected as well."""
    n = results.groupBy("task").agg(F.min("problem").alias("__p"), F.count(F.lit(1)).alias("__n"), F.first("result", ignorenulls=True).alias("result"))
    j = tasks.select(F.col("task").alias("__task")).distinct().join(n, F.col("__task") == F.col("task"), "full_outer")
    problem = F.when(F.col("task").isNull(), "missing").when(F.col("__task").isNull(), "unexpected").when(F.col("__n") > 1, "repeated").otherwise(F.col("__p"))
    return j.select(F.coalesce("task", "__task").alias("task"), F.when(problem.isNull(), F.col("result")).alias("result"), problem.alias("problem"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small report or JSON document, which takes the place of an older one in one step: readers find either of them."""
    staged, fs = hadoop_path(spark, f"{path}.staged-{uuid.uuid4().hex}")
    target = hadoop_path(spark, path)[0]
    try:
        out = fs.create(staged)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        jvm = spark._jvm
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri() if staged.toUri().getScheme() else fs.getUri(), fs.getConf())
        context.rename(fs.makeQualified(staged), fs.makeQualified(target), over)
    finally:
        if fs.exists(staged):
            fs.delete(staged, False)


def read_manifest(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Enabled units of a manifest document (schema_version, units[...]); ids must be unique."""
    doc = spark.read.option("multiLine", True).json(path)
    if (have := doc.select("schema_version").first()[0]) != version:
        raise ValueError(f"schema version {have}, not {version}")
    units = doc.select(F.explode("units").alias("u")).select("u.*")
    flag = F.coalesce("enabled", F.lit(True)) if "enabled" in units.columns else F.lit(True)
    out = units.where(flag)
    if out.groupBy("unit_id").count().where("count > 1").take(1):
        raise ValueError("a unit id occurs twice")
    return out


def manifest_text(units: list[dict], version: int = 1) -> str:
    return json.dumps({"schema_version": version, "units": units}, sort_keys=True)


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small aggregate as a Markdown table; rows beyond the limit are counted in its last line."""
    rows = df.limit(limit + 1).collect()
    line = lambda r: "| " + " | ".join("" if v is None else str(v) for v in r) + " |"
    more = [line([f"and {df.count() - limit} more", *[""] * (len(df.columns) - 1)])] if len(rows) > limit else []
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows[:limit]), *more])
