"""Properties that SQL parity doesn't show: errors, byte-exact digests, independence of partitions, and fixtures by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import hashing
from quern.functions import vectors as V
from quern.operators import batching, catalog, checks, corpus, metrics, sampling, tensors
from quern.session import ranges, setting
from quern.sources import records


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_digests_have_known_values():
    """Values worked out by hand from the formats: lengths, big-endian numbers, personal strings."""
    raw = b"\x00\x00\x00\x01r" + b"\x00\x00\x00\x03a/p" + (5).to_bytes(8, "big")
    assert hashing.row_id("r", "a\\p", 5, b"own") == hashlib.blake2b(raw, digest_size=16, person=b"own").digest() != hashing.row_id("r", "a/p", 5, b"other")
    assert hashing.row_id("r", "a/p", 5, b"own") != hashing.row_id("r", "a/p", 6, b"own")
    assert hashing.shard_id("p", b"own") == hashlib.blake2b(b"p", digest_size=8, person=b"own").digest()
    assert hashing.unit_seed(42, "default", "é") == int.from_bytes(hashlib.blake2b('[42,"default","é"]'.encode(), digest_size=8).digest(), "big")
    for bad in ("", "/a", "a/../b", "..\\a"):
        with pytest.raises(ValueError):
            hashing.normal_path(bad)


def test_digest_column_keeps_nulls(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    one = lambda x: hashing.document_id(x, b"own")
    assert rows(hashing.with_digest(d, "h", ["t"], one), "i", "h") == [(1, one("a").hex()), (2, None)]


def test_digest_queries_match_plain_code(spark):
    from quern.plans.registry import QUERIES
    from quern.plans.scans import ROW_PERSON, SHARD_PERSON

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert rows(QUERIES["f01_row_ids"](spark, sf), "doc_id", "sample_id") == sorted((r.doc_id, hashing.row_id("release", f"raw/{r.source}", r.doc_id, ROW_PERSON).hex()) for r in docs)
    assert rows(QUERIES["f03_shard_ids"](spark, sf), "shard_id") == sorted({(hashing.shard_id(f"{r.source}/{r.lang}", SHARD_PERSON).hex(),) for r in docs})
    assert rows(QUERIES["f02_unit_seeds"](spark, sf), "seed") == sorted({(hashing.unit_seed(42, "default", r.source).to_bytes(8, "big").hex(),) for r in docs})
    want = []
    for u in {r.source for r in docs}:
        own = sorted(r.doc_id for r in docs if r.source == u)
        want += [(u, own[i]) for i in sampling.pcg64_indices(len(own), 20, hashing.unit_seed(42, "default", u))]
    assert rows(QUERIES["t01_pcg64_sample"](spark, sf), "source", "doc_id") == sorted(want)


def skewed(spark, n=4000):
    """One group with nine tenths of all rows, a null group, and small ones; values that repeat."""
    return spark.createDataFrame([("big" if i % 10 else None if i % 40 == 0 else f"g{i % 7}", i * 37 % n, i % 13) for i in range(n)], "g string, o long, v long").repartition(6)


def by_group(d):
    out = {}
    for r in sorted(d.collect(), key=lambda r: r.o):
        out.setdefault(r.g, []).append((r.o, r.v))
    return out


def test_running_and_lagged_with_one_large_group(spark):
    d = skewed(spark)
    sums, last = {}, {}
    for g, x in by_group(d).items():
        total = np.cumsum([v for _, v in x]).tolist()
        for k, (o, _) in enumerate(x):
            sums[o], last[o] = (total[k], k + 1), x[k - 1] if k else (None, None)
    got = corpus.running(d, ["g"], ["o"], total=F.col("v"), n=F.lit(1)).collect()
    assert len(got) == 4000 and {r.o: (r.total, r.n) for r in got} == sums
    got = corpus.lagged(d, ["g"], ["o"], before="o", value="v").collect()
    assert len(got) == 4000 and {r.o: (r.before, r.value) for r in got} == last
    # no task of the plan sees more than its range: the groups of a window are (range, unit)
    plan = corpus.running(d, ["g"], ["o"], total=F.col("v"))._jdf.queryExecution().toString()
    assert "Window [sum(__total" in plan and "[__part" in plan


def test_fingerprint_of_long_units(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FAN", 16)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def of(values):
        first = True
        while first or len(values) > 1:
            parts = [values[i : i + 16] for i in range(0, len(values), 16)]
            values, first = [sha(",".join(p)) if first or len(p) > 1 else p[0] for p in parts], False
        return values[0]

    d = skewed(spark, 2000).where("g IS NOT NULL")
    want = {g: of([str(v) for _, v in x]) for g, x in by_group(d).items()}
    assert {r.g: r.fingerprint for r in corpus.fingerprint(d, ["g"], ["o"], "v").collect()} == want
    other = d.withColumn("v", F.when(F.col("o") == 7, 99).otherwise(F.col("v")))
    changed = {r.g for r in corpus.fingerprint(other, ["g"], ["o"], "v").collect() if r.fingerprint != want[r.g]}
    assert len(changed) == 1


def test_smoothing_of_a_long_run(spark):
    d = skewed(spark).where("g IS NOT NULL")
    want = {}
    for g, x in by_group(d).items():
        ema = x[0][1]
        for _, v in x[1:]:
            ema = 0.3 * v + 0.7 * ema
        want[g] = (len(x), round(ema, 9))
    assert {r.g: (r.n, round(r.ema, 9)) for r in metrics.smoothed(d, "g", "o", "v", 0.3).collect()} == want


def test_queries_with_one_large_group_match_their_sql(spark, tmp_path):
    """Nine tenths of all documents in one source: numbering, neighbours, lists and lock-step comparison stay right."""
    import duckdb

    from quern.plans.registry import ORACLES, QUERIES
    from test_parity import normal

    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 700) AS text", "CASE WHEN id % 3 = 0 THEN 'en' ELSE 'de' END AS lang", "CASE WHEN id % 10 > 0 THEN 'src2' ELSE concat('src', id % 9) END AS source", "id % 50 AS n_chars")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("a23_selection_fingerprint", "j04_lockstep_mismatch", "j13_logical_row_location", "p16_index_violations", "p20_stale_units", "w08_neighbour_negative", "v11_group_layout"):
        got, want = QUERIES[name](spark, f"file://{tmp_path}").toPandas(), con.sql(ORACLES[name]).df()
        assert normal(got) == normal(want), name


def test_pairs_and_deltas_are_checked(spark):
    d = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "a", 3)], "k string, s string, v int")
    assert rows(catalog.complete_pairs(d.where("k = 'p'"), "k", "s", "v"), "k", "a", "b") == [("p", 1, 2)]
    for bad in (d, d.limit(0), d.where("k = 'p'").unionByName(d.where("k = 'p'"))):
        with pytest.raises(checks.ConstraintError):
            catalog.complete_pairs(bad, "k", "s", "v")
    rng = np.random.default_rng(0)
    b, a = rng.normal(size=(4, 2)), rng.normal(size=(2, 3))
    long = lambda x: spark.createDataFrame([("k", i, j, float(v)) for (i, j), v in np.ndenumerate(x)], "key string, i long, j long, x double")
    for turn, want in ((False, 0.5 * b @ a), (True, 0.5 * (b @ a).T)):
        got = tensors.low_rank_delta(long(b), long(a), 0.5, turn)
        assert np.allclose([r.x for r in got.orderBy("i", "j").collect()], want.ravel())
        assert tensors.checked_delta(got, long(want)).count() == 12
        with pytest.raises(checks.ConstraintError):
            tensors.checked_delta(got, long(want.T))
    with pytest.raises(checks.ConstraintError):
        catalog.manifest_units(spark.createDataFrame([('{"unit_id": "u"}',)], "t string"), "t", ["n"], []).count()
    with pytest.raises(checks.ConstraintError):
        checks.audit(d, "k", 3, spark.createDataFrame([], "k string, expected long"))


def test_scores_in_blocks(spark):
    x = np.random.default_rng(0).normal(size=(300, 5)).round(1)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>").repartition(5)
    q = d.where("doc_id < 30").withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r.doc_id): r.score for r in metrics.blocked_scores(q, d, block_bytes=300).collect()}
    assert len(got) == 9000 and all(abs(got[i, j] - x[i] @ x[j]) < 1e-9 for i, j in got)
    top = metrics.top_k(metrics.blocked_scores(q, d, 4, 3000), "query_id", "doc_id", "score", 4).collect()
    want = {(i, int(j)) for i in range(30) for j in np.lexsort((np.arange(300), -(x[i] @ x.T)))[:4]}
    assert len(top) == 120 and len({(r.query_id, r.doc_id) for r in top} & want) >= 118  # ties in the last digit


def test_pcg64_matches_numpy():
    want = sorted(np.random.Generator(np.random.PCG64(7)).choice(1000, size=10, replace=False))
    assert sampling.pcg64_indices(1000, 10, 7) == want
    assert sampling.pcg64_indices(5, 10, 7) == [0, 1, 2, 3, 4]


def test_capped_sample_ignores_partitions_and_follows_the_seed(spark):
    d = spark.range(500).withColumn("u", F.col("id") % 3)
    pick = lambda df, s: rows(sampling.capped(df, ["u"], F.col("id"), 20, seed=s), "id")
    assert pick(d, 1) == pick(d.repartition(7), 1) != pick(d, 2)
    assert len(pick(d, 1)) == 60


def test_factor_sampling_repeats_and_rejects(spark):
    d = spark.range(10).withColumn("u", F.lit(1))
    assert sampling.factor(d, ["u"], F.col("id"), 2.5).count() == 25
    with pytest.raises(ValueError):
        sampling.factor(d, ["u"], F.col("id"), 0)


def test_negatives_are_ordered_by_number_and_filtered(spark):
    d = spark.createDataFrame([(1, "c", "a", None), (2, "", None, "b")], "i int, negative_10 string, negative_2 string, negative_1 string")
    assert [(r.i, r.negatives, r.n_removed) for r in corpus.nest_negatives(d).orderBy("i").collect()] == [(1, ["a", "c"], 1), (2, ["b"], 2)]
    with pytest.raises(ValueError):
        corpus.nest_negatives(d.select("i"))


def test_dedup_by_first_occurrence(spark):
    d = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "o long, t string").repartition(3)
    assert rows(corpus.dedup(d, "t", "o"), "doc_id", "text", "n_refs") == [(0, "b", 2), (1, "a", 1), (2, "c", 1)]


def test_rank_slices_join_to_the_batch(spark):
    for world in (1, 2, 4):
        d = spark.range(8).withColumn("rank", batching.rank_of(F.col("id"), 8, world))
        assert rows(d.groupBy("rank").count(), "rank", "count") == [(r, 8 // world) for r in range(world)]
    with pytest.raises(ValueError):
        batching.rank_of(F.col("id"), 8, 3)


def test_plan_drops_the_partial_batch(spark):
    d = spark.range(19).withColumn("s", F.lit("x"))
    assert batching.plan(d, "s", "id", 4).count() == 16


def test_overlaps_and_location(spark):
    s = spark.createDataFrame([(1, "p", 0, 10), (2, "p", 10, 20), (3, "p", 15, 30), (4, "q", None, None), (5, "q", 5, 6)], "shard_id long, path string, row_start long, row_stop long")
    assert rows(catalog.overlaps(s), "shard_a", "shard_b") == [(2, 3), (4, 5)]
    o = spark.createDataFrame([("u", 1, 0, 3), ("u", 2, 3, 5)], "unit string, shard_id long, lo long, hi long")
    q = spark.createDataFrame([("u", 0), ("u", 3), ("u", 4), ("u", 5)], "unit string, r long")
    assert rows(catalog.locate(q, o, "unit", "r"), "r", "shard_id", "inner_row") == [(0, 1, 0), (3, 2, 0), (4, 2, 1)]


def test_exclusion_precedence(spark):
    u = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0)], "unit string, bad int")
    got = catalog.exclusion_status(u, F.col("bad") == 1, False, ["b"], ["c"], "unit")
    assert rows(got, "unit", "reason") == [("a", "contaminated"), ("b", None), ("c", "excluded")]
    with pytest.raises(ValueError):
        catalog.exclusion_status(u, F.col("bad") == 1, False, ["b"], ["b"], "unit")


def test_constraints_raise(spark):
    d = spark.range(3)
    with pytest.raises(checks.ConstraintError):
        checks.assert_empty(d, "x")
    with pytest.raises(checks.ConstraintError):
        checks.assert_count(d, 4)
    with pytest.raises(checks.ConstraintError):
        checks.assert_schema(d, spark.createDataFrame([], "id string").schema)
    assert checks.assert_count(checks.assert_schema(d, d.schema), 3) is d


def test_nearest_rank_and_missing_scores(spark):
    for n in (1, 19, 20, 21, 100):
        d = spark.range(1, n + 1)
        want = -(-95 * n // 100)
        assert d.agg(metrics.nearest_rank("id", 0.95)).first()[0] == want == d.agg(F.collect_list("id").alias("v")).select(metrics.nearest_rank_of(F.col("v"), 0.95)).first()[0]
    res = spark.createDataFrame([("a", 0.5, 2.0)], "task string, score double, seconds double")
    tasks = spark.createDataFrame([("a", "c"), ("b", "c")], "task string, category string")
    assert rows(metrics.category_scores(res, tasks), "category", "n_missing", "score") == [("c", 1, 0.25)]


def test_vectors_by_hand(spark):
    d = spark.createDataFrame([([3.0, 4.0], [4.0, -3.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    r = d.select(V.norm(a), V.cosine(a, b), V.cosine(a, z), V.normalise(a), V.nll(F.array(F.lit(1000.0), F.lit(1000.0)), F.lit(0)), *V.slerp_weights(V.cosine(a, z), F.lit(0.25))).first()
    assert r[0] == 5 and r[1] == 0 and r[2] is None and np.allclose(r[3], [0.6, 0.8])
    assert abs(r[4] - np.log(2)) < 1e-12 and (r[5], r[6]) == (0.75, 0.25)
    tokens = F.array(a, b, z)
    last = lambda *m: d.select(V.pool(tokens, F.array(*map(F.lit, m)), "last")).first()[0]
    assert last(1, 1, 0) == [4.0, -3.0] and last(0, 1, 1) == [0.0, 0.0]


def test_record_files(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"query": "q1", "pos": ["p"]}\n\n{"query": "q2"}\n')
    (tmp_path / "a.json").write_text('[{"query": "q0", "neg": []}]')
    assert rows(records.read_records(spark, f"file://{tmp_path}"), "query") == [("q0",), ("q1",), ("q2",)]
    (tmp_path / "c.jsonl").write_text('{"query": \n')
    with pytest.raises(Exception):
        records.read_records(spark, f"file://{tmp_path}").collect()
    with pytest.raises(ValueError):
        records.read_records(spark, f"file://{tmp_path}/none" if (tmp_path / "none").mkdir() is None else "")


def test_publish_never_overwrites(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    records.publish(spark.range(5), path)
    assert records.open_table(spark, path, spark.range(5).schema, 5).count() == 5
    with pytest.raises(FileExistsError):
        records.publish(spark.range(5), path)


def test_publish_swaps_and_rolls_back(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    for n in (5, 7):
        records.publish(spark.range(n), path, replace=True)
        assert spark.read.parquet(path).count() == n
    monkeypatch.setattr(records, "_renamed", lambda *a: False)
    with pytest.raises(OSError):
        records.publish(spark.range(9), path, replace=True)
    assert spark.read.parquet(path).count() == 7 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]
    with pytest.raises(Exception):
        records.publish(spark.range(9).selectExpr("assert_true(id < 3)", "id"), path, replace=True)
    assert spark.read.parquet(path).count() == 7 and sorted(x.name for x in tmp_path.iterdir()) == ["t"]


def test_documents_are_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/d.json"
    for text in ("one", "two"):
        records.write_text(spark, path, text)
        assert (tmp_path / "d.json").read_text() == text
    assert [x.name for x in tmp_path.iterdir() if not x.name.startswith(".")] == ["d.json"]


def test_inventory_reads_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for k in range(3):
        pq.write_table(pa.table({"a": list(range(10 + k)), "b": ["x"] * (10 + k)}), tmp_path / f"f{k}.parquet", row_group_size=4)
    got = {r.path: r for r in records.inventory(spark, f"file://{tmp_path}").collect()}
    assert [got[f"f{k}.parquet"].row_group_rows for k in range(3)] == [[4, 4, 2], [4, 4, 3], [4, 4, 4]]
    assert len({r.schema_fingerprint for r in got.values()}) == 1 and len({r.metadata_fingerprint for r in got.values()}) == 3
    assert all(r.size == (tmp_path / r.path).stat().st_size and r.n_rows == sum(r.row_group_rows) for r in got.values())
    handle = records._HadoopFile(spark, f"file://{tmp_path}/f1.parquet")
    *found, sizes = records._footer("f1.parquet", pa.PythonFile(handle, mode="r"))
    assert (*found, dict(sizes)) == tuple(got["f1.parquet"])[1:] and [len(n) for n in dict(sizes).values()] == [3, 3]


def test_reports_say_what_they_leave_out(spark):
    text = records.markdown_table(spark.range(5), 3)
    assert text.endswith("| 2 |\n| and 2 more |") and "more" not in records.markdown_table(spark.range(3), 3)


def events(spark, folder, part, rows_):
    spark.createDataFrame(rows_, "user string, seq long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{folder}/{part}")


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """A second run on the same base sees only new files, and its view still holds what the first one had."""
    from datetime import datetime

    from quern.streaming import telemetry as S

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    folder, schema = f"file://{tmp_path}/in", "user string, seq long, ts timestamp, value double"
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    hours = lambda: S.windowed(source().withColumn("event_type", F.lit("x")))
    views = {}
    for k, rows_ in enumerate(([("a", 1, at(1), 1.0), ("b", 2, at(1, 5), 2.0)], [("a", 3, at(3), 4.0), ("c", 0, at(1, 30), 9.0)], [("d", 9, at(6), 1.0)])):
        events(spark, folder, k, rows_)
        views[k] = sorted(tuple(r) for r in S.upsert_latest(source().select("user", "seq", "value"), "user", "seq", f"file://{tmp_path}/up").collect())
        windows = sorted((r.window_start.hour, r.n) for r in S.run_to_table(hours(), base=f"file://{tmp_path}/win").collect())
        ema = S.run_to_table(S.smoothed(source(), "user", "seq", "value", 0.5), "update", f"file://{tmp_path}/ema")
    assert views == {0: [("a", 1, 1.0), ("b", 2, 2.0)], 1: [("a", 3, 4.0), ("b", 2, 2.0), ("c", 0, 9.0)], 2: [("a", 3, 4.0), ("b", 2, 2.0), ("c", 0, 9.0), ("d", 9, 1.0)]}
    assert windows == [(1, 3), (3, 1)]  # of the last hour nothing is certain yet
    assert sorted((r.user, r.n, r.ema) for r in ema.where("user = 'a'").collect()) == [("a", 1, 1.0), ("a", 2, 2.5)]


def test_attempt_logs_fold(spark, tmp_path):
    from quern.sources import attempts

    log = f"file://{tmp_path}/log"
    d = spark.range(10).selectExpr("id % 3 AS k", "id AS seq")
    assert attempts.read(spark, log, d.schema).count() == 0
    for n in (4, 10):
        attempts.append(log, d.where(F.col("seq") < n), f"e{n}")
        attempts.append(log, d.where(F.col("seq") < n), f"e{n}")
    view = rows(attempts.latest(attempts.read(spark, log, d.schema), "k", "seq"), "k", "seq")
    attempts.fold(spark, log, d.schema, "k", "seq", 1)
    assert view == [(0, 9), (1, 7), (2, 8)] == rows(attempts.read(spark, log, d.schema), "k", "seq")


def test_open_units_keep_their_state(spark, tmp_path):
    from quern.streaming import telemetry as S

    folder = f"file://{tmp_path}/in"
    for k, units in enumerate(("abac", "ab")):
        spark.createDataFrame([("w", 10 * k + i, u) for i, u in enumerate(units)], "worker string, step long, unit string").coalesce(1).write.parquet(f"{folder}/{k}")
        s = spark.readStream.schema("worker string, step long, unit string").option("recursiveFileLookup", True).parquet(folder)
        got = S.run_to_table(S.open_units(s, "worker", "step", "unit", 2), base=f"file://{tmp_path}/b")
    assert sorted((r.step, r.opened, r.evicted) for r in got.collect()) == [(0, "a", None), (1, "b", None), (3, "c", "b"), (11, "b", "c")]


def test_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    records.write_text(spark, path, records.manifest_text([{"unit_id": "a"}, {"unit_id": "b", "enabled": False}]))
    assert rows(records.read_manifest(spark, path), "unit_id") == [("a",)]
    with pytest.raises(ValueError):
        records.read_manifest(spark, path, version=2)


def test_clean_deletes_own_tables(spark):
    from quern import session

    t = session.materialise(spark.range(3), "x")
    assert t.count() == 3
    session.clean(spark)
    with pytest.raises(Exception):
        spark.read.parquet(session.own_dir(spark)).count()


def test_temporary_tables_are_deleted(spark):
    from quern import session

    with session.temporary_tables(spark) as keep:
        a = keep(session.materialise(spark.range(3), "a"))
        with session.temporary_tables(spark) as inner:
            b = session.materialise(spark.range(4), "b")
            c = inner(session.materialise(spark.range(5), "c"))
        assert c.count() == 5
        with pytest.raises(Exception):
            b.count()
    assert a.count() == 3
    with pytest.raises(Exception):
        c.count()


def test_ranges_follow_the_bytes_read(spark, tmp_path):
    spark.range(100_000).write.parquet(f"{tmp_path}/t")
    df, n = spark.read.parquet(f"{tmp_path}/t"), 4
    size = sum(p.stat().st_size for p in tmp_path.glob("t/*.parquet"))
    with setting(spark, "spark.sql.shuffle.partitions", str(n)):
        assert ranges(df) == n and ranges(df, size // 10) in (10, 11, 12)
        assert ranges(df.join(df.withColumnRenamed("id", "b"), F.col("id") == F.col("b")), size // 10) in (20, 21, 22, 23)
        assert ranges(spark.createDataFrame([(1,)], "id long"), 1000) == n
