"""The workflow on small files: caps, ranges, exclusion, determinism, verification and batches."""

import json

import pytest

from quern.functions import hashing
from quern.plans import workflow as W

DOC = {
    "schema_version": 1,
    "dataset_release_id": "rel",
    "profiles": {"p": {"sample_limit": 12, "default_seed": 1, "enabled_sources": ["a", "b", "c"], "excluded_contaminated_sources": ["c"], "expected_source_count": 3}},
    "sources": [
        {"source_id": "a", "task_type": "retrieval", "language": "en", "sampling_units": [{"sampling_unit_id": "a1", "shards": ["x.parquet", {"path": "y.parquet", "row_start": 0, "row_stop": 5}]}]},
        {"source_id": "b", "task_type": "clustering", "language": "de", "sampling_units": [{"sampling_unit_id": "b1", "shards": [{"path": "y.parquet", "row_start": 5, "row_stop": 9}]}]},
        {"source_id": "c", "task_type": "retrieval", "language": "fr", "sampling_units": [{"sampling_unit_id": "c1", "shards": ["z.parquet"]}]},
        {"source_id": "d", "task_type": "retrieval", "language": "fr", "sampling_units": []},
    ],
}


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    top = tmp_path_factory.mktemp("raw")
    for name, n in (("x", 20), ("y", 10), ("z", 6)):
        rows = [(f"{name} q{i}" if i != 3 else None, f"p{i % 7}", f"n{i % 3}", None if i % 2 else f"m{i}") for i in range(n)]
        pq.write_table(pa.table({c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(("query", "passage", "negative_1", "negative_2"))}), top / f"{name}.parquet", row_group_size=4)
    return f"file://{top}"


def plan(spark, root, **options):
    sel = W.Selection("p", **options)
    shards = W.bind(spark, DOC, root, sel)
    return shards, W.draw(spark, DOC, shards, root, sel)


def keys(index):
    return sorted((r.unit_id, r.path, r.row_index) for r in index.collect())


def test_plan(spark, root):
    shards, index = plan(spark, root)
    got = keys(index)
    assert [sum(k[0] == u for k in got) for u in ("a1", "b1", "c1")] == [12, 4, 0]
    assert all(5 <= r < 9 for u, _, r in got if u == "b1") and all(r < 5 for u, p, r in got if u == "a1" and p == "y.parquet")
    assert keys(plan(spark, root)[1]) == got != keys(plan(spark, root, seed=2)[1])
    r = index.first()
    assert r.sample_id == hashing.row_id("rel", r.path, r.row_index, b"quern-row").hex()
    assert {r.unit_id: r.reason for r in shards.collect()} == {"a1": None, "b1": None, "c1": "contaminated"}
    assert keys(plan(spark, root, include=["c1"], only=["c1"])[1]) == [("c1", "z.parquet", i) for i in range(6)]
    total = W.report(shards, index).where("task_type = 'total'").first()
    assert (total.n_sources, total.n_units, total.n_active_units, total.n_rows, total.n_selected) == (3, 3, 2, 35, 16)
    assert W.query_total_warning(index, 16) is None and "16 queries" in W.query_total_warning(index, 17)


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d.update(schema_version=2),
        lambda d: d["profiles"]["p"].update(expected_source_count=4),
        lambda d: d["sources"][0].update(task_type="other"),
        lambda d: d["sources"][0]["sampling_units"][0]["shards"].append("y.parquet"),
        lambda d: d["sources"][1]["sampling_units"][0]["shards"][0].update(row_stop=11),
        lambda d: d["sources"][1]["sampling_units"][0]["shards"][0].update(path="../y.parquet"),
        lambda d: d["sources"][1]["sampling_units"][0].update(sampling_unit_id="a1"),
        lambda d: d["profiles"]["p"].update(source_unit_overrides={"a": [{"sampling_unit_id": "o", "shards": ["x.parquet"]}]}),
    ],
)
def test_bad_catalogues(spark, root, change):
    doc = json.loads(json.dumps(DOC))
    change(doc)
    with pytest.raises(ValueError):
        W.bind(spark, W.parse_catalog(json.dumps(doc)), root, W.Selection("p"))


def test_compile_and_batches(spark, root, tmp_path):
    shards, index = plan(spark, root)
    c = W.compile_units(spark, shards, index, root, f"file://{tmp_path}/out")
    assert W.verify(c).count() == 0
    m = {r.unit_id: r for r in c.manifest.collect()}
    assert m["a1"].selected == 12 and m["a1"].query_count + m["a1"].dropped == 12 and m["b1"].dropped == 0
    docs = {(r.unit_id, r.doc_id): r.text for r in c.corpus.collect()}
    for q in c.queries.collect():
        i = q.source_row_index
        assert docs[q.unit_id, q.positive_doc_id] == f"p{i % 7}"
        assert [docs[q.unit_id, d] for d in q.negative_doc_ids] == [f"n{i % 3}"] + ([] if i % 2 else [f"m{i}"])
        assert q.lang == {"a1": "en", "b1": "de"}[q.unit_id]
    one, two = (sorted(map(tuple, W.batches(c, 4, 3, world_size=w, prompts=["find"]).collect())) for w in (1, 2))
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in one] == [(r[0], r[1], r[2], r[4], r[5]) for r in two]
    assert {(r[2], r[3]) for r in two} == {(p, p // 2) for p in range(4)}
    assert all(len(r[5]) == 3 and r[4].startswith("Instruct: find\nQuery: ") for r in one)
    assert len(one) == 4 * sum(r.query_count // 4 for r in m.values())
    files = spark.createDataFrame([(u, f) for u in m for f in ("queries", "corpus")], "unit_id string, file string")
    fresh = W.Compiled(c.queries, c.corpus, W.corpus.fingerprint(index, ["unit_id"], ["sample_id"], "sample_id"))
    assert W.resume(fresh, DOC, W.Selection("p"), index, files).count() == 0
    stale = lambda x, f=files: {(r.unit_id, r.reason) for r in W.resume(fresh, DOC, W.Selection("p"), x, f).collect()}
    assert stale(index.where("row_index <> 1")) <= {("a1", "stale fingerprint"), ("b1", "stale fingerprint")} and stale(index, files.where("file = 'corpus' OR unit_id = 'a1'")) == {("b1", "incomplete")}
    broken = W.Compiled(c.queries, c.corpus.where("doc_id <> 1"), c.manifest)
    assert {r.problem for r in W.verify(broken).collect()} >= {"document ids"}


def test_open_units():
    assert W.open_units(list("abacab"), 2) == [(0, "a", None), (1, "b", None), (3, "c", "b"), (5, "b", "c")]
