"""Queries on sources, sinks and scalar functions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import hashing
from quern.operators import checks, tensors
from quern.plans.declare import Tables, query
from quern.session import ranges
from quern.sources import files, records


@query("s01_json_records", "SELECT text AS query, lang || ',' || source AS pos, CASE WHEN doc_id % 2 = 0 THEN lang END AS prompt FROM documents")
def s01(t: Tables) -> DataFrame:
    out = records.scratch(t.spark, "records") + ".jsonl"
    t.documents.select(F.col("text").alias("query"), F.array("lang", "source").alias("pos"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("prompt")).write.json(out)
    return records.read_records(t.spark, out).select("query", F.array_join("pos", ",").alias("pos"), "prompt")


@query("s02_footer_inventory")
def s02(t: Tables) -> DataFrame:
    return records.inventory(t.spark, f"{t.sf_dir}/documents.parquet").drop("schema", "uri", "column_bytes")


@query("s02_footer_totals", "SELECT count(*) AS n_rows, true AS groups_add_up, 5 AS n_columns FROM documents")
def s02b(t: Tables) -> DataFrame:
    """What footers say of a table against the table itself."""
    rows = records.inventory(t.spark, f"{t.sf_dir}/documents.parquet")
    groups = F.aggregate("row_group_rows", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.agg(F.sum("n_rows").alias("n_rows"), F.every(groups == F.col("n_rows")).alias("groups_add_up"), F.max(F.json_array_length("schema")).alias("n_columns"))


@query("s03_positional_scan", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def s03(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/documents.parquet"
    at = t.spark.read.parquet(path).select("doc_id", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
    return records.read_selected(t.spark, path, at.join(t.labels, "doc_id", "left_semi").drop("doc_id"), ["doc_id"]).select("doc_id")


@query("s04_first_row", "SELECT min(doc_id) AS doc_id FROM documents")
def s04(t: Tables) -> DataFrame:
    return records.first_rows(t.spark, f"{t.sf_dir}/documents.parquet").agg(F.min("doc_id").alias("doc_id"))


@query("s05_table_scan", "SELECT page_id, length(html) AS n FROM pages")
def s05(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.length("html").cast("long").alias("n"))


@query("s06_published_table", "SELECT doc_id, lang, text FROM documents")
def s06(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "published")
    df = t.documents.select("doc_id", "lang", "text")
    records.publish(df, path, records_per_file=4096)
    return records.open_table(t.spark, path, df.schema, t.documents.count())


@query("s08_manifest_scan", "SELECT source AS unit_id, count(*) AS n FROM documents WHERE source <> 'src4' GROUP BY source")
def s08(t: Tables) -> DataFrame:
    units = t.documents.groupBy("source").count().orderBy("source").collect()
    path = records.scratch(t.spark, "manifest") + ".json"
    records.write_text(t.spark, path, records.manifest_text([{"unit_id": r["source"], "n": r["count"]} | ({"enabled": False} if r["source"] == "src4" else {}) for r in units]))
    return records.read_manifest(t.spark, path).select("unit_id", "n")


@query("s09_config_folders", "SELECT lang AS config, count(*) AS n FROM documents GROUP BY lang")
def s09(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "configs")
    t.documents.select("doc_id", F.col("lang").alias("config")).write.partitionBy("config").parquet(path)
    return t.spark.read.parquet(path).groupBy("config").agg(F.count(F.lit(1)).alias("n"))


@query("s10_result_documents", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, false AS corrupt FROM events WHERE event_id % 4 > 0 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 4 = 0")
def s10(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, F.lit("{broken")).otherwise(F.col("props"))
    j = F.from_json(text, "k long, _corrupt_record string", {"mode": "PERMISSIVE"})
    return t.events.select("event_id", j.alias("j")).select("event_id", "j.k", F.col("j._corrupt_record").isNotNull().alias("corrupt"))


@query(
    "s10_result_files",
    "WITH s AS (SELECT source, count(*) AS n, regexp_extract(source, '([0-9]+)$', 1)::INT AS k FROM documents GROUP BY source) SELECT source AS task, CASE WHEN k % 3 > 0 THEN n END AS n, CASE WHEN k % 3 = 0 THEN 'corrupt' END AS problem FROM s WHERE k % 5 > 0 UNION ALL SELECT source, NULL, 'missing' FROM s WHERE k % 5 = 0",
)
def s10b(t: Tables) -> DataFrame:
    """A result document a source, some of them broken, against all sources as expected tasks."""
    out = records.scratch(t.spark, "results")
    k = F.regexp_extract("source", "([0-9]+)$", 1).cast("int")
    n = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(k % 5 > 0)
    text = F.when(k % 3 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("n")))
    n.select(F.col("source").alias("task"), text.alias("value")).write.partitionBy("task").text(out)
    found = records.read_results(t.spark, out, "n long", "/task=([^/]*)/", "*.txt")
    return records.expected_results(found, t.documents.select(F.col("source").alias("task"))).select("task", "result.n", "problem")


@query("s11_result_listing", "SELECT 'lang=' || lang AS folder FROM (SELECT DISTINCT lang FROM documents)")
def s11(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "listing")
    t.documents.select("lang", "doc_id").write.partitionBy("lang").json(path)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "(lang=[^/]*)/", 1).alias("folder")).distinct()


@query("s13_index_archive", "SELECT source, doc_id AS row_index FROM documents")
def s13(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "index")
    t.documents.select("source", F.col("doc_id").alias("row_index")).repartitionByRange("source", "row_index").sortWithinPartitions("source", "row_index").write.partitionBy("source").parquet(path)
    return t.spark.read.parquet(path).select("source", "row_index")


@query("s14_csv_sink", "SELECT doc_id, lang, text FROM documents")
def s14(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "csv")
    t.documents.select("doc_id", "lang", "text").write.option("escape", '"').csv(path, header=True)
    return t.spark.read.option("multiLine", True).option("escape", '"').schema("doc_id long, lang string, text string").csv(path, header=True)


@query("s15_jsonl_sink", "SELECT event_id, event_type, value FROM events")
def s15(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "jsonl")
    t.events.select("event_id", "event_type", "value").write.json(path)
    return t.spark.read.schema("event_id long, event_type string, value double").json(path)


@query("s16_markdown_report", "WITH r AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT '| lang | count |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || lang || ' | ' || n || ' |', chr(10) ORDER BY lang) AS report FROM r")
def s16(t: Tables) -> DataFrame:
    text = records.markdown_table(t.documents.groupBy("lang").count().orderBy("lang"))
    return t.spark.createDataFrame([(text,)], "report string")


@query("s19_dedup_scratch", "SELECT md5(text) AS digest, count(*) AS n FROM documents GROUP BY text")
def s19(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5("text").alias("digest"), "text").agg(F.count(F.lit(1)).alias("n")).drop("text")


@query("s20_tensor_table", "SELECT vec_id, round(sum(i * x), 4) AS s FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY vec_id")
def s20(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "tensors")
    values = t.embeddings.select(F.col("vec_id").cast("string").alias("key"), F.lit(0).cast("long").alias("i"), F.posexplode("embedding").alias("j", "x"))
    tensors.write_tensors(values.withColumns({"j": F.col("j").cast("long"), "x": F.col("x").cast("double")}), path)
    back = tensors.read_tensors(t.spark, path)
    return back.groupBy(F.col("key").cast("long").alias("vec_id")).agg(F.round(F.sum(F.col("j") * F.col("x")), 4).alias("s"))


@query("s22_capped_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) SELECT doc_id, k::INT AS k, line FROM l WHERE k <= 3 AND trim(line) <> ''")
def s22(t: Tables) -> DataFrame:
    l = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))  # noqa: E741
    return l.select("doc_id", (F.col("k") + 1).alias("k"), "line").where("k <= 3 AND trim(line) <> ''")


# Ids need their data set's personalisation; these are this engine's own.
ROW_PERSON, SHARD_PERSON = b"quern-row", b"quern-shard"


@query("f01_row_ids")
def f01(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.concat(F.lit("raw\\"), "source").alias("path"))
    return hashing.with_digest(d, "sample_id", ["path", "doc_id"], lambda p, r: hashing.row_id("release", p, r, ROW_PERSON))


def _values(pairs: Iterable[tuple[str, bytes]]) -> str:
    return ", ".join(f"('{k}', '{v.hex()}')" for k, v in pairs)


# Known ids of all sources and languages that the tables may hold, straight from their definition.
_SOURCES = [f"src{i}" for i in range(32)]
_SEEDS = _values((s, hashlib.blake2b(f'[42,"default","{s}"]'.encode(), digest_size=8).digest()) for s in _SOURCES)
_SHARD_IDS = _values((f"{s}/{g}", hashlib.blake2b(f"{s}/{g}".encode(), digest_size=8, person=SHARD_PERSON).digest()) for s in _SOURCES for g in ("de", "en", "es", "fr"))


@query("f02_unit_seeds", f"WITH k(source, h) AS (VALUES {_SEEDS}) SELECT source, h AS seed FROM k WHERE source IN (SELECT source FROM documents)")
def f02(t: Tables) -> DataFrame:
    return hashing.with_digest(t.documents.select("source").distinct(), "seed", ["source"], lambda s: hashing.unit_seed(42, "default", s).to_bytes(8, "big"))


@query("f03_shard_ids", f"WITH k(path, h) AS (VALUES {_SHARD_IDS}) SELECT path, h AS shard_id FROM k WHERE path IN (SELECT source || '/' || lang FROM documents)")
def f03(t: Tables) -> DataFrame:
    d = t.documents.select(F.concat_ws("/", "source", "lang").alias("path")).distinct()
    return hashing.with_digest(d, "shard_id", ["path"], lambda p: hashing.shard_id(p, SHARD_PERSON))


@query("f05_content_sha256", "SELECT doc_id, sha256(text) AS query_key FROM documents")
def f05(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("query_key"))


@query("f06_document_digest", "SELECT doc_id, substr(sha256('doc' || text), 1, 32) AS digest FROM documents")
def f06(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring(F.sha2(F.concat(F.lit("doc"), "text"), 256), 1, 32).alias("digest"))


@query("f08_path_normalise", "SELECT page_id, replace(url, '/', chr(92)) AS raw, url AS path, regexp_matches(url, '^/|(^|/)\\.\\.(/|$)') OR url = '' AS rejected FROM pages")
def f08(t: Tables) -> DataFrame:
    raw = F.translate("url", "/", "\\")
    path = F.translate(raw, "\\", "/")
    return t.pages.select("page_id", raw.alias("raw"), path.alias("path"), (F.regexp_like(path, F.lit(r"^/|(^|/)\.\.(/|$)")) | (path == "")).alias("rejected"))


@query("f13_numeric_suffix", "SELECT doc_id, regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS n FROM documents")
def f13(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.regexp_extract("source", "([0-9]+)$", 1).cast("long").alias("n"))


@query("f15_language_codes", "SELECT doc_id, replace(lang || '-XX', '-', '_') AS code, split_part(lang || '-en', '-', 2) AS target FROM documents")
def f15(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.replace(F.concat("lang", F.lit("-XX")), F.lit("-"), F.lit("_")).alias("code"), F.split_part(F.concat("lang", F.lit("-en")), F.lit("-"), F.lit(2)).alias("target"))


@query("f16_hex", "SELECT doc_id, lower(hex(source)) AS h, source AS back FROM documents")
def f16(t: Tables) -> DataFrame:
    h = F.lower(F.hex("source"))
    return t.documents.select("doc_id", h.alias("h"), F.unhex(h).cast("string").alias("back"))


@query("f18_key_rewrite", "SELECT DISTINCT p_name, regexp_replace(p_name, '^[a-z]+ ', '') AS stripped, regexp_matches(p_name, '(red|blue)$') AS matched, round(p_size / sqrt(8.0), 6) AS scale FROM part")
def f18(t: Tables) -> DataFrame:
    return t.part.select("p_name", F.regexp_replace("p_name", "^[a-z]+ ", "").alias("stripped"), F.regexp_like("p_name", F.lit("(red|blue)$")).alias("matched"), F.round(F.col("p_size") / F.sqrt(F.lit(8.0)), 6).alias("scale")).distinct()


@query("f04_canonical_digest", "SELECT doc_id, md5('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}') AS digest FROM documents")
def f04(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.to_json(F.struct("lang", "source"))).alias("digest"))


@query("s07_checked_reader", "SELECT vec_id, label FROM embeddings")
def s07(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "checked")
    df = t.embeddings.select("vec_id", "label")
    records.publish(df, path)
    return records.open_table(t.spark, path, df.schema, df.count())


@query("s12_catalog_document", "SELECT source AS source_id, lang AS unit_id, source || '/' || lang || '.parquet' AS path, CASE WHEN min(doc_id) % 2 = 0 THEN min(doc_id) END AS row_start, CASE WHEN min(doc_id) % 2 = 0 THEN max(doc_id) + 1 END AS row_stop FROM documents GROUP BY source, lang")
def s12(t: Tables) -> DataFrame:
    """A catalogue in YAML, written and read again, with a shard as a path alone or with its rows."""
    from quern.plans.workflow import catalog_shards, parse_catalog

    units = t.documents.groupBy("source", "lang").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).orderBy("source", "lang").collect()
    lines, last = ["schema_version: 1", "sources:"], None
    for r in units:
        if r["source"] != last:
            last = r["source"]
            lines += [f"- source_id: {last}", "  sampling_units:"]
        shard = f"{r['source']}/{r['lang']}.parquet"
        lines += [f"  - sampling_unit_id: {r['lang']}", f"    shards: [{{path: {shard}, row_start: {r['lo']}, row_stop: {r['hi'] + 1}}}]" if r["lo"] % 2 == 0 else f"    shards: [{shard}]"]
    path = records.scratch(t.spark, "catalogue") + ".yaml"
    records.write_text(t.spark, path, "\n".join(lines) + "\n")
    text = t.spark.read.text(path, wholetext=True).first()[0]
    return t.spark.createDataFrame(catalog_shards(parse_catalog(text)), "source_id string, unit_id string, path string, row_start long, row_stop long")


@query("s17_atomic_document", "SELECT count(*) AS version, 'done' AS state FROM documents")
def s17(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "state") + ".json"
    records.write_text(t.spark, path, '{"version": 0, "state": "begun"}')
    records.write_text(t.spark, path, f'{{"version": {t.documents.count()}, "state": "done"}}')
    return t.spark.read.schema("version long, state string").json(path)


@query("s17_replaced_table", "SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 1")
def s17b(t: Tables) -> DataFrame:
    """A published table that a newer one takes the place of."""
    path = records.scratch(t.spark, "swapped")
    for k in (0, 1):
        records.publish(t.documents.select("doc_id", "lang").where(F.col("doc_id") % 2 == k), path, replace=True)
    return t.spark.read.parquet(path)


@query("s18_zstd_tables", "SELECT item_id, text FROM benchmark")
def s18(t: Tables) -> DataFrame:
    path = records.scratch(t.spark, "zstd")
    records.publish(t.benchmark.select("item_id", "text"), path, records_per_file=4096, compression="zstd")
    return t.spark.read.parquet(path)


@query("t13_stable_order", "SELECT source, lang, row_number() OVER (ORDER BY source, lang) - 1 AS ordinal FROM (SELECT DISTINCT source, lang FROM documents)")
def t13(t: Tables) -> DataFrame:
    from quern.operators.corpus import dense_ids

    return dense_ids(t.documents.select("source", "lang").distinct(), ["source", "lang"], "ordinal")


@query("p21_count_audit", "SELECT source, count(*) AS n, count(l.doc_id) AS expected, count(*) <> count(l.doc_id) AS warning FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source")
def p21(t: Tables) -> DataFrame:
    """Rows of each source against a stated number, here its labelled ones; another number of sources would be an error."""
    expected = t.documents.join(t.labels.select(F.col("doc_id").alias("known")), F.col("doc_id") == F.col("known"), "left").groupBy("source").agg(F.count("known").alias("expected"))
    return checks.audit(t.documents, "source", expected.count(), expected)


@query("s01_record_ordinals", "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, text AS query FROM documents")
def s01b(t: Tables) -> DataFrame:
    """Records of several files with their number over all of them."""
    out = records.scratch(t.spark, "numbered")
    t.documents.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id").select(F.col("text").alias("query")).write.json(out)
    return records.numbered_records(t.spark, out).select("ordinal", "query")


@query("s06_record_batches", "SELECT event_id, user_id, event_type, value, props FROM events")
def s06b(t: Tables) -> DataFrame:
    """A table in bounded Arrow record batches, whose sizes, numbers and digests are checked when it is read."""
    out = records.scratch(t.spark, "batches")
    files.write_batches(t.events.select("event_id", "user_id", "event_type", "value", "props"), out)
    return files.read_batches(t.spark, out, verify=True)


@query("s13_archive_files", "SELECT source AS shard, doc_id AS value FROM documents")
def s13b(t: Tables) -> DataFrame:
    out = records.scratch(t.spark, "archive")
    files.write_index_archive(t.documents, "source", "doc_id", out)
    return files.read_index_archive(t.spark, out)


@query("s18_sealed_table", "SELECT doc_id, lang, text FROM documents")
def s18b(t: Tables) -> DataFrame:
    """A table that is published with digests of its files and opened after these were checked."""
    out, df = records.scratch(t.spark, "sealed"), t.documents.select("doc_id", "lang", "text")
    files.publish_sealed(df, out, records_per_file=4096)
    return files.open_sealed(t.spark, out, df.schema)


@query("s20_tensor_files", "SELECT vec_id, round(sum(i * x), 4) AS s FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY vec_id")
def s20b(t: Tables) -> DataFrame:
    out = records.scratch(t.spark, "tensors")
    values = t.embeddings.select(F.col("vec_id").cast("string").alias("key"), F.lit(0).cast("long").alias("i"), F.posexplode("embedding").alias("j", "x"))
    names = files.write_tensors(values.withColumns({"j": F.col("j").cast("long"), "x": F.col("x").cast("double")}), out, shard_bytes=64 << 20)
    back = files.read_tensors(t.spark, [f"{out}/{n}" for n in names])
    return back.groupBy(F.col("key").cast("long").alias("vec_id")).agg(F.round(F.sum(F.col("j") * F.col("x")), 4).alias("s"))


@query("s22_source_lines", "SELECT lang, line, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS line FROM documents) WHERE line < 100")
def s22b(t: Tables) -> DataFrame:
    """The first hundred lines of each source, whose lines lie in order in the files of its folder.

    Folders are named by numbers: names could be null or hold any character, and over names that may be null Spark's writer
    puts a sort of its own, which undoes the order of lines. A source may be in several files, one a range.
    """
    from quern.operators.corpus import dense_ids

    sources = dense_ids(t.documents.select(F.col("lang").alias("name")).distinct(), ["name"], "source")
    rows = t.documents.select("doc_id", "lang").join(sources, F.col("lang").eqNullSafe(F.col("name"))).select("doc_id", "source")
    order = ["source", F.col("doc_id").asc_nulls_last()]
    out = records.scratch(t.spark, "lines")
    rows.repartitionByRange(ranges(rows), *order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string").alias("value"), "source").write.partitionBy("source").text(out)
    lines = records.capped_lines(t.spark, [f"{out}/source=*/*.txt"], 100)
    part, source = (F.regexp_extract("file", p, 1).cast("long") for p in ("/part-([0-9]+)", "/source=([0-9]+)/"))
    # at most a hundred rows of each file are left, and Spark keeps as many of each task before it deals them
    place = F.row_number().over(Window.partitionBy("source").orderBy("part", "file", "line"))
    first = lines.withColumns({"part": part, "source": source}).withColumn("place", place).where("place <= 100")
    return first.join(sources, "source").select(F.col("name").alias("lang"), (F.col("place") - 1).cast("long").alias("line"), F.expr("try_cast(value AS long)").alias("doc_id"))
