"""Arrow record batches, sealed tables, index archives, tensor files and numbered lines."""

import json
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.plans.registry import ORACLES, QUERIES
from quern.sources import files, records


def flip(path):
    raw = bytearray(path.read_bytes())
    raw[len(raw) // 2] ^= 1
    path.write_bytes(raw)


# ---------------------------------------------------------------- Arrow record batches


def test_batches_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(0, 1000, 1, 3).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("x"), F.col("id").cast("string"))).alias("s"), F.array("id", "id").alias("a"), F.to_timestamp(F.col("id").cast("timestamp")).alias("ts"))
    files.write_batches(df, path, rows=100)
    manifest = json.loads((tmp_path / "t/_manifest.json").read_text())
    assert manifest["rows"] == 1000 and sorted(f["batches"] for f in manifest["files"]) == [4, 4, 4]
    got = files.read_batches(spark, path, verify=True, run=2)
    assert got.schema == df.schema and got.rdd.getNumPartitions() == 6
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert files.read_batches(spark, path, "id long").agg(F.sum("id")).first()[0] == 499500
    with pytest.raises(Exception, match="FileExists"):
        files.write_batches(df, path)
    files.write_batches(df.where("id < 5"), path, overwrite=True)
    assert files.read_batches(spark, path).count() == 5
    files.write_batches(df.limit(0), str(tmp_path / "none"))
    assert files.read_batches(spark, str(tmp_path / "none")).collect() == []
    assert [x.name for x in tmp_path.iterdir() if "staged" in x.name] == []


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(10).select(F.raise_error(F.lit("broken")).cast("string").alias("s"))
    with pytest.raises(Exception, match="broken"):
        files.write_batches(bad, str(tmp_path / "t"))
    assert list(tmp_path.iterdir()) == []


def test_reader_checks(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_batches(spark.range(0, 500, 1, 1), path, rows=50)
    part = next((tmp_path / "t").glob("*.arrow"))
    whole, manifest = part.read_bytes(), tmp_path / "t/_manifest.json"
    flip(part)
    with pytest.raises(Exception, match="digest"):
        files.read_batches(spark, path, verify=True).collect()
    part.write_bytes(whole[:-8])
    with pytest.raises(Exception, match="bytes, not"):
        files.read_batches(spark, path).collect()
    part.write_bytes(whole)
    m = json.loads(manifest.read_text())
    m["files"][0]["batches"] = 9
    manifest.write_text(json.dumps(m))
    with pytest.raises(Exception, match="10 batches, not 9"):
        files.read_batches(spark, path).collect()
    m["files"][0]["batches"], m["schema"] = 10, spark.range(1).select(F.col("id").cast("int").alias("id")).schema.json()
    manifest.write_text(json.dumps(m))
    with pytest.raises(Exception, match="schema"):
        files.read_batches(spark, path).collect()


# ---------------------------------------------------------------- sealed tables


def test_a_changed_byte_is_found(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100)
    files.publish_sealed(df, path, records_per_file=30)
    assert files.open_sealed(spark, path, df.schema).count() == 100
    parts = sorted((tmp_path / "t").glob("*.parquet"))
    flip(parts[0])
    parts[1].unlink()
    (tmp_path / "t/part-new.parquet").write_bytes(b"x")
    problems = {r.file: r.problem for r in files.seal_problems(spark, path).collect()}
    assert problems == {parts[0].name: "changed", parts[1].name: "missing", "part-new.parquet": "unknown"}
    with pytest.raises(ValueError, match="changed"):
        files.open_sealed(spark, path, df.schema)
    with pytest.raises(FileExistsError):
        files.publish_sealed(df, path)


# ---------------------------------------------------------------- index archives


def test_archives_are_equal_whatever_the_partitions(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s/"), (F.col("id") % 5).cast("string"))).alias("shard"), ((F.col("id") * 7919) % 2003).alias("v"))
    df = df.unionByName(spark.createDataFrame([(None, 1), ("x", None)], "shard string, v long"))
    out = []
    for k, n in enumerate((1, 7)):
        path = str(tmp_path / f"a{k}")
        written = files.write_index_archive(df.repartition(n), "shard", "v", path, segment=256).collect()
        out.append(sorted(map(tuple, written)))
        got = files.read_index_archive(spark, path)
        assert got.exceptAll(df.where("shard IS NOT NULL AND v IS NOT NULL").withColumnRenamed("v", "value")).count() == 0 and got.count() == 3000
        assert {p.name: p.read_bytes() for p in (tmp_path / "a0").iterdir()} == {p.name: p.read_bytes() for p in (tmp_path / f"a{k}").iterdir()}
    assert out[0] == out[1] and max(r[3] for r in out[0]) == 256
    name = next(r[0] for r in out[0] if r[1] == "hot")
    assert np.load(tmp_path / "a0" / name).dtype == np.int64


# ---------------------------------------------------------------- tensor files


@pytest.mark.parametrize("kind", ["F32", "F64", "F16", "BF16"])
def test_tensors_round_trip(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(files, "CHUNK_BYTES", 800)
    monkeypatch.setattr(files, "SPLIT_BYTES", 512)
    rng = np.random.default_rng(0)
    want = {"b": rng.normal(size=(30, 20)), "a": rng.normal(size=(1, 7)), "c": rng.normal(size=(40, 11))}
    rows = [(k, i, j, float(x[i, j])) for k, x in want.items() for i in range(x.shape[0]) for j in range(x.shape[1])]
    df = spark.createDataFrame(rows, "key string, i long, j long, x double").repartition(4)
    names = files.write_tensors(df, str(tmp_path / "m"), kind, shard_bytes=1500)
    assert len(names) >= 2 and set(json.loads((tmp_path / "m/model.safetensors.index.json").read_text())["weight_map"]) == set(want)
    paths = [str(tmp_path / "m" / n) for n in names]
    got = {k: np.zeros(x.shape) for k, x in want.items()}
    seen = 0
    for r in files.read_tensors(spark, paths).collect():
        got[r.key][r.i, r.j] = r.x
        seen += 1
    assert seen == len(rows)
    for k, x in want.items():
        assert np.allclose(got[k], x, rtol={"F64": 0, "F32": 1e-6, "F16": 1e-2, "BF16": 1e-2}[kind], atol=1e-3 * (kind[-2:] == "16"))


def test_broken_tensor_files_are_refused(spark, tmp_path):
    header = json.dumps({"__metadata__": {"a": "b"}, "t": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}}).encode()
    whole = struct.pack("<Q", len(header)) + header + np.arange(4, dtype="<f4").tobytes()
    p = tmp_path / "t.safetensors"
    p.write_bytes(whole)
    assert [tuple(r) for r in files.read_tensors(spark, str(p)).orderBy("i", "j").collect()] == [("t", 0, 0, 0.0), ("t", 0, 1, 1.0), ("t", 1, 0, 2.0), ("t", 1, 1, 3.0)]
    for bad in (whole[:-1], whole + b"x", whole[:6], struct.pack("<Q", 1 << 40) + header, whole.replace(b"[2, 2]", b"[2, 3]"), whole.replace(b"F32", b"F99")):
        p.write_bytes(bad)
        with pytest.raises(ValueError):
            files.read_tensors(spark, str(p))
    with pytest.raises(ValueError, match="whole"):
        files.write_tensors(spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, 1, 1.0)], "key string, i long, j long, x double"), str(tmp_path / "m"))


# ---------------------------------------------------------------- numbered lines


def test_lines_are_numbered_over_splits(spark, tmp_path):
    texts = {"b.jsonl": [f"line {i} " + "x" * (i % 50) for i in range(700)], "a.jsonl": ["one"], "c.jsonl": [str(i) for i in range(30)]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = records.numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 4
        rows = got.collect()
        capped = records.capped_lines(spark, str(tmp_path), 2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    every = [(n, k, x) for n in sorted(texts) for k, x in enumerate(texts[n])]
    assert sorted((r.ordinal, r.file.rpartition("/")[2], r.line, r.value) for r in rows) == [(o, *x) for o, x in enumerate(every)]
    assert sorted((r.file.rpartition("/")[2], r.line) for r in capped) == [("a.jsonl", 0), ("b.jsonl", 0), ("b.jsonl", 1), ("c.jsonl", 0), ("c.jsonl", 1)]


def test_first_lines_of_sources_in_order(spark, tmp_path):
    """Sources in many files whose rows lie in no order, of any name or none."""
    names = ["de", "en", "a/b=c %41", None]
    rows = [(i * 7919 % 4000, names[i % 4 if i % 3 else 1]) for i in range(4000)] + [(9000 + i, "few") for i in range(3)] + [(None, "few")]
    spark.createDataFrame(rows, "doc_id long, lang string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["s22_source_lines"](spark, f"file://{tmp_path}").collect()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLES["s22_source_lines"]).fetchall()
    assert len(want) == 404 and sorted(map(str, ((r.lang, r.line, r.doc_id) for r in got))) == sorted(map(str, want))


def test_records_are_numbered_without_blank_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"query": "p"}\n\n{"query": "q"}\n')
    (tmp_path / "b.jsonl").write_text('{"query": "r"}\n')
    assert sorted((r.ordinal, r.query) for r in records.numbered_records(spark, str(tmp_path)).collect()) == [(0, "p"), (1, "q"), (2, "r")]
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        records.numbered_records(spark, str(tmp_path)).collect()
