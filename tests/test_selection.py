"""Positional reads, block scoring, interval sweeps, exact quantiles and abstention curves against brute force."""

import math
import random
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.operators import catalog, checks, corpus, metrics, quantiles
from quern.plans.registry import QUERIES
from quern.sources import records

# ---------------------------------------------------------------- positional reads


@pytest.fixture
def many_groups(tmp_path):
    """Two files of 50 and 20 row groups of 100 rows, with columns of different widths."""
    for name, n in (("a", 5000), ("b", 2000)):
        t = pa.table({"id": pa.array(range(n)), "wide": [f"{name}{i}" * 20 for i in range(n)], "list": [[i, i + 1] for i in range(n)], "at": pa.array(range(n), pa.timestamp("us"))})
        pq.write_table(t, tmp_path / f"{name}.parquet", row_group_size=100, compression="none", use_dictionary=False)
    return tmp_path


def index_of(spark, *rows):
    return spark.createDataFrame(list(rows), "file_name string, row_index long")


def test_only_selected_row_groups_are_read(spark, many_groups):
    path = str(many_groups)
    index = index_of(spark, ("a.parquet", 0), ("a.parquet", 99), ("a.parquet", 99), ("a.parquet", 4900), ("b.parquet", 777))
    groups = {(r.file_name, r.row_group): r for r in records.selected_groups(spark, path, index, ["id"]).collect()}
    assert {k: (r.first_row, list(r.rows)) for k, r in groups.items()} == {("a.parquet", 0): (0, [0, 99]), ("a.parquet", 49): (4900, [0]), ("b.parquet", 7): (700, [77])}
    size = sum((many_groups / f).stat().st_size for f in ("a.parquet", "b.parquet"))
    assert sum(r.bytes for r in groups.values()) < size / 50
    wide = records.selected_groups(spark, path, index, ["id", "wide", "list"]).agg(F.sum("bytes")).first()[0]
    assert sum(r.bytes for r in groups.values()) < wide < size / 15
    # nothing else is touched: the other groups' bytes may be anything
    f = pq.ParquetFile(many_groups / "a.parquet")
    raw = bytearray((many_groups / "a.parquet").read_bytes())
    for g in range(1, 49):
        for c in range(f.metadata.row_group(g).num_columns):
            m = f.metadata.row_group(g).column(c)
            raw[m.data_page_offset : m.data_page_offset + m.total_compressed_size] = b"\xff" * m.total_compressed_size
    (many_groups / "a.parquet").write_bytes(raw)
    got = records.read_selected(spark, path, index, ["id", "wide", "list", "at"])
    assert sorted((r.file_name, r.row_index, r.id, r.wide, r.list) for r in got.collect()) == [(f"{n}.parquet", i, i, f"{n}{i}" * 20, [i, i + 1]) for n, i in (("a", 0), ("a", 99), ("a", 4900), ("b", 777))]
    assert got.where("file_name = 'b.parquet'").select(F.unix_micros(F.col("at").cast("timestamp"))).first()[0] == 777


def test_rows_that_are_not_there_are_errors(spark, many_groups):
    for bad in (("a.parquet", 5000), ("a.parquet", -1), ("c.parquet", 0), ("a.parquet", None), (None, 1)):
        with pytest.raises(Exception, match="no such row"):
            records.read_selected(spark, str(many_groups), index_of(spark, ("a.parquet", 1), bad), ["id"]).collect()
    assert records.read_selected(spark, str(many_groups), index_of(spark), ["id"]).collect() == []


def test_every_row_can_be_selected(spark, many_groups):
    every = spark.range(5000).select(F.lit("a.parquet").alias("file_name"), F.col("id").alias("row_index"))
    got = records.read_selected(spark, [str(many_groups / "a.parquet")], every, ["wide", "id"])
    assert got.columns == ["wide", "id", "file_name", "row_index"] and got.where("id = row_index").count() == 5000


# ---------------------------------------------------------------- block scoring


@pytest.mark.parametrize("block_bytes", [1 << 24, 1500])
def test_block_grid_matches_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(metrics, "TILE", 64)
    rng = np.random.default_rng(4)
    q, d = rng.integers(-3, 4, (23, 6)), rng.integers(-3, 4, (71, 6))  # whole numbers give many ties
    frame = lambda x, name, step: spark.createDataFrame([(i * step, [float(v) for v in r]) for i, r in enumerate(x)] + [(-5, None)], f"{name} long, v array<double>")
    queries, docs = frame(q, "query_id", 10), frame(d, "doc_id", 3)
    want = {(i * 10, j * 3): float(q[i] @ d[j]) for i in range(23) for j in range(71)}
    got = metrics.blocked_scores(queries, docs, block_bytes=block_bytes).collect()
    assert len(got) == len(want) and {(r.query_id, r.doc_id): r.score for r in got} == want
    for k in (1, 4, 100):
        top = metrics.blocked_scores(queries, docs, k, block_bytes).collect()
        best = {i * 10: sorted((-want[i * 10, j * 3], j * 3) for j in range(71))[:k] for i in range(23)}
        assert sorted((r.query_id, -r.score, r.doc_id) for r in top) == sorted((i, s, j) for i, b in best.items() for s, j in b)


def test_no_scores_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, v array<double>")
    docs = spark.createDataFrame([(1, [1.0])], "doc_id long, v array<double>")
    assert metrics.blocked_scores(none, docs).collect() == [] == metrics.blocked_scores(none, docs, 3).collect()


def test_pairs_repeat_ids_in_files(spark, tmp_path):
    """Pairs of a few documents at a time: their ids are kept as codes, and a pair takes little more than its score."""
    rng = np.random.default_rng(7)
    d = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(30_000)], "doc_id long, v array<double>")
    metrics.blocked_scores(d.where("doc_id < 40").withColumnRenamed("doc_id", "query_id"), d, digits=6).coalesce(1).write.parquet(f"{tmp_path}/out")
    (f,) = (tmp_path / "out").glob("*.parquet")
    m = pq.ParquetFile(f).metadata
    assert m.num_rows == 1_200_000 and f.stat().st_size < 10 * m.num_rows


def test_pairs_of_equal_scores_lie_side_by_side_in_files(spark, tmp_path):
    """Scores that repeat, but are too many for a file's codes: a pair takes less than a score, and none is lost or changed."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3_000, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, v array<double>")
    metrics.blocked_scores(d.where("doc_id < 400").withColumnRenamed("doc_id", "query_id"), d, digits=5).coalesce(1).write.parquet(f"{tmp_path}/out")
    (f,) = (tmp_path / "out").glob("*.parquet")
    got = pq.read_table(f).to_pandas().sort_values(["query_id", "doc_id"])
    assert (got.query_id.to_numpy() == np.repeat(np.arange(400), 3_000)).all() and (got.doc_id.to_numpy() == np.tile(np.arange(3_000), 400)).all()
    assert np.abs(got.score.to_numpy() - (x[:400] @ x.T).ravel()).max() < 0.51e-5
    assert got.score.nunique() > 1 << 17 and f.stat().st_size < 6.5 * len(got)


@pytest.mark.parametrize("block_bytes", [1 << 24, 1500])
def test_first_relevant_matches_brute_force(spark, monkeypatch, block_bytes):
    """Ties, unknown labels, a query without a positive and one without a negative, scores that round up and that are no number."""
    monkeypatch.setattr(metrics, "TILE", 64)
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (71, 4)) / 16  # whole sixteenths give ties, and halves of the last digit in products
    x[33, 0], x[34, 1] = np.nan, np.inf
    label = [None if i % 9 == 4 else 7 if i == 10 else 2**60 + i % 3 for i in range(71)]
    d = spark.createDataFrame([(i, [float(v) for v in r], c) for i, (r, c) in enumerate(zip(x, label))], "doc_id long, v array<double>, label long")
    for rows in (list(range(71)), [30]):
        docs = d.where(F.col("doc_id").isin(rows))
        got = {r.query_id: r for r in metrics.first_relevant(docs.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id"), docs, 2, block_bytes).collect()}
        for i in (i for i in rows if i % 5 == 0):
            s = {j: half_up(float(x[i] @ x[j])) for j in rows if j != i}
            order = sorted(s, key=lambda j: (not np.isnan(s[j]), -s[j] if not np.isnan(s[j]) else 0, j))
            pos = [j for j in order if label[i] is not None and label[j] == label[i]]
            neg = [j for j in order if None not in (label[i], label[j]) and label[j] != label[i]]
            want = (order.index(pos[0]) + 1 if pos else None, s[pos[0]] if pos else None, s[neg[0]] if neg else None)
            have = (got[i].first, got[i].pos, got[i].neg) if i in got else (None, None, None)
            assert [v if v is None else v + 0.0 for v in have] == pytest.approx([v if v is None else v + 0.0 for v in want], abs=0, nan_ok=True)


def half_up(x):
    return x if not np.isfinite(x) else float(np.copysign(np.floor(abs(x) * 100 + 0.5) / 100, x)) + 0.0


def test_scores_send_no_pairs(spark, tmp_path):
    """Plans of the queries on scores deal vectors and rows of queries; labels come with them."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=8)], i % 4) for i in range(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "scores")
    try:
        n = QUERIES["j15_similarity"](spark, f"file://{tmp_path}").agg(F.count(F.lit(1)), F.sum("score")).first()[0]
        QUERIES["a31_proxy_eval"](spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n == 60 * 2999
    tracker, store = spark.sparkContext.statusTracker(), spark._jsc.sc().statusStore()
    stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) <= 4 * 3000


# ---------------------------------------------------------------- overlapping ranges


def found(spark, rows):
    df = spark.createDataFrame(rows, "path string, shard_id int, row_start long, row_stop long")
    return sorted(map(tuple, catalog.overlaps(df).collect()))


def pairs(rows):
    whole = [(p, i, a or 0, 1 << 62 if b is None else b) for p, i, a, b in rows if p is not None and i is not None]
    return sorted((p, i, j) for p, i, a, b in whole for q, j, c, d in whole if p == q and i < j and max(a, c) < min(b, d))


def test_overlaps_match_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        a = rng.randint(0, 2000)
        rows.append((rng.choice(["hot"] * 8 + ["x", "y"]), i, a, a + rng.choice([0, 1, 3, 20, 900])))
    rows += [("hot", 1000, None, None), ("x", 1001, None, 5), ("y", 1002, 1990, None), ("hot", 5, 0, 50), (None, 1003, 0, 9), ("hot", None, 0, 9), ("z", 1004, None, None), ("hot", 1005, 7, 3)]
    assert found(spark, rows) == pairs(rows)
    assert found(spark, []) == []


def test_one_overlap_in_a_large_path_is_cheap(spark):
    n = 100_000
    shards = spark.range(n).select(F.lit("one").alias("path"), F.col("id").cast("int").alias("shard_id"), (F.col("id") * 10).alias("row_start"), F.when(F.col("id") == 500, 5015).otherwise(F.col("id") * 10 + 10).cast("long").alias("row_stop"))
    t = time.time()
    assert [tuple(r) for r in catalog.overlaps(shards).collect()] == [("one", 500, 501)]
    assert time.time() - t < 60  # pairs of all shards would be 5 * 10^9


# ---------------------------------------------------------------- quantiles


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(7)
    values = {"hot": rng.normal(size=9000), "ties": rng.integers(0, 4, 700).astype(float), "one": np.array([2.5]), None: rng.normal(size=300)}
    rows = [(g, float(v)) for g, x in values.items() for v in x] + [("hot", None), ("empty", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in quantiles.nearest_ranks(df, ["g"], "x", **shares).collect()}
    assert set(got) == set(values)
    for g, x in values.items():
        x = np.sort(x)
        assert got[g].n == len(x)
        assert [got[g][p] for p in shares] == [x[max(1, math.ceil(len(x) * q)) - 1] for q in shares.values()]
    between = {r.g: r for r in quantiles.interpolated(df, ["g"], "x", **shares).collect()}
    for g, x in values.items():
        assert [between[g][p] for p in shares] == pytest.approx([float(np.quantile(x, q)) for q in shares.values()])
    assert quantiles.nearest_ranks(df.limit(0), ["g"], "x", p=0.5).collect() == []
    whole = quantiles.interpolated(df, [], "x", p=0.9).first()
    assert whole.p == pytest.approx(float(np.quantile(np.concatenate(list(values.values())), 0.9)))


def test_quantiles_with_counts(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 2, 1), ("a", 9, 6)], "g string, x int, c long")
    assert tuple(quantiles.nearest_ranks(df, ["g"], "x", "c", p30=0.3, p40=0.4, p41=0.41).first()) == ("a", 10, 1, 2, 9)


# ---------------------------------------------------------------- abstention


def area_gained(conf, metric):
    n, rates = len(conf), [i / 10 for i in range(10)]
    curve = lambda key: [np.mean([metric[i] for i in sorted(range(n), key=lambda i: (key[i], i))[min(round(r * n), n - 1) :]]) for r in rates]
    own, best = curve(conf), curve(metric)
    area = lambda c: sum((c[i] + c[i + 1]) * 0.05 for i in range(9))
    flat = best[0] * 0.9
    return None if abs(area(best) - flat) <= 1e-12 else (area(own) - flat) / (area(best) - flat)


def test_nauc_matches_the_curves(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 25, 203):
        conf, m = rng.integers(0, 30, n) / 10, rng.random(n)
        df = spark.createDataFrame([(i, float(conf[i]), float(m[i]), float(m[i]), 0.5) for i in range(n)], "query_id int, c double, m double, self double, flat double")
        got = {(r.metric, r.confidence): r.nauc for r in metrics.nauc(df, "query_id", ["m", "flat"], ["c", "self"]).collect()}
        want = area_gained(conf.tolist(), m.tolist())
        assert got["m", "c"] == (None if want is None else pytest.approx(want, abs=1e-6))
        assert got["flat", "c"] is None and (got["m", "self"] == 1.0 or n == 1)
    assert [r.nauc for r in metrics.nauc(df.limit(0), "query_id", ["m"], ["c"]).collect()] == [None]


def test_confidences(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.5, 2), (1, 0.1, 3), (2, 0.3, 1)], "query_id int, score double, rank int")
    got = {r.query_id: (r.max, r.std, r.diff1) for r in metrics.confidences(df, "query_id", "score").collect()}
    assert got[1] == pytest.approx((0.9, np.std([0.9, 0.5, 0.1]), 0.4)) and got[2] == (0.3, 0.0, 0.0)


# ---------------------------------------------------------------- alignment and result files


def test_alignment_names_the_first_differences(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, shape string")
    same = [(f"t{i:02d}", "2x3") for i in range(20)]
    checks.assert_aligned({"a": frame(same), "b": frame(same[::-1]), "c": frame(same)}, "k", ["shape"])
    other = [*same[:4], ("t04", "3x2"), ("t05", None), *same[7:], ("t07", "2x3"), ("new", "1")]
    got = dict(map(tuple, checks.differences({"a": frame(same), "b": frame(other)}, "k", ["shape"]).collect()))
    assert got == {"t04": "b has shape 3x2, not 2x3", "t05": "b has shape null, not 2x3", "t06": "b lacks it", "t07": "b repeats it", "new": "a lacks it"}
    with pytest.raises(checks.ConstraintError, match="^20 keys differ: t00: b lacks it; .*t09: b lacks it$"):
        checks.assert_aligned({"a": frame(same), "b": frame([])}, "k", ["shape"])


def test_results_against_expected_tasks(spark, tmp_path):
    for name, text in (("a", '{"score": 0.5}'), ("b", "{broken"), ("sub/c", '{"score": 1.0, "more": [1]}'), ("extra", '{"score": 2}'), ("e", ""), ("sub/a", '{"score": 7}')):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "note.txt").write_text("{}")
    found = records.read_results(spark, str(tmp_path), "score double")
    got = {r.task: (r.result.score if r.result else None, r.problem) for r in records.expected_results(found, spark.createDataFrame([(x,) for x in "abcde"], "task string")).collect()}
    assert got == {"a": (None, "repeated"), "b": (None, "corrupt"), "c": (1.0, None), "d": (None, "missing"), "e": (None, "missing"), "extra": (None, "unexpected")}


def test_keys_of_tasks_and_their_parts(spark):
    part = "struct<type:string,path:string,revision:string,subset:string>"
    kind = f"type string, path string, revision string, subset string, parts array<{part}>"
    data = [
        ("Reranking", "p", "r", "default", None),
        ("MyReranking", "p", "r", None, []),
        ("MyReranking", "q", None, "en", None),
        ("Retrieval", "x", "r", "en", None),
        (None, "x", "r", "en", None),
        ("Reranking", "whole", "r", "en", [("Retrieval", "x", "r", "en"), ("Reranking", "in", "r", "default"), (None, "x", "r", "en")]),
        ("Other", "whole", "r", "en", [("Reranking", "in", "r", "de"), ("Reranking", "in", "r", "de")]),
    ]
    got = {tuple(r) for r in catalog.task_keys(spark.createDataFrame(data, kind), "Reranking").collect()}
    assert got == {("p", "r", None), ("q", None, "en"), ("in", "r", None), ("in", "r", "de")}
    assert catalog.task_keys(spark.createDataFrame([], kind), "Reranking").count() == 0


def test_candidates_are_recovered_only_beside_a_negative(spark):
    q = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 3, 1), ("b", 4, None), ("c", 5, None), (None, 6, 0)], "unit string, doc long, score int")
    assert {r[0]: r[1] for r in corpus.has_negatives(q, "unit", "score").collect()} == {"a": True, "b": False, "c": False, None: True}
    got = corpus.recovered_candidates(q, "unit", "score")
    assert got.columns == q.columns and sorted(tuple(r) for r in got.collect()) == [("a", 1, 1), ("a", 2, 0)]


def test_results_of_two_runs_side_by_side(spark):
    kind = "task string, subset string, score double, revision string"
    a = spark.createDataFrame([("t", None, 0.5, "r1"), ("t", "en", 0.5, None), ("u", None, None, "r1"), ("l", None, 1.0, "r1")], kind)
    b = spark.createDataFrame([("t", None, 0.75, "r2"), ("t", "en", 0.25, None), ("u", None, 1.0, "r1"), ("r", None, 2.0, "r1")], kind)
    got = {(r.task, r.subset): (r.delta, r.found, r.same_revision) for r in catalog.compare_results(a, b, ["task", "subset"], "score", ["revision"]).collect()}
    assert got == {("t", None): (0.25, "both", False), ("t", "en"): (-0.25, "both", True), ("u", None): (None, "both", True), ("l", None): (None, "left", None), ("r", None): (None, "right", None)}


def test_metadata_against_a_manifest(spark):
    kind = "unit string, n long, digest string"
    stored = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 3, "z"), ("d", 4, "w")], kind)
    want = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), ("c", 4, None), ("e", 5, "v")], kind)
    got = sorted(map(tuple, checks.metadata_problems(stored, want, "unit", ["n", "digest"]).collect()), key=str)
    assert got == [("c", "digest", "z", None), ("c", "n", "3", "4"), ("d", "unit", "d", None), ("e", "unit", None, "e")]
    same = stored.where("unit < 'c'")
    assert checks.assert_metadata(same, same, "unit", ["n", "digest"]).count() == 2
    with pytest.raises(checks.ConstraintError, match="^metadata: .*digest"):
        checks.assert_metadata(stored, want, "unit", ["n", "digest"])
