"""Queries on catalogues, joins and references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import catalog, checks, corpus, sampling
from quern.plans.declare import PAIRS, WIDE, Tables, md5_number, pairs, query, wide
from quern.sources import records

# Shards made from suppliers: a path per nation, ranges by key, one in nine without a range.
_SHARDS = "sh AS (SELECT s_suppkey AS shard_id, 'p' || s_nationkey AS path, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey * 10 END AS row_start, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey * 10 + 200 END AS row_stop FROM supplier)"


def _shards(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("shard_id"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("path"), F.when(k % 9 > 0, k * 10).alias("row_start"), F.when(k % 9 > 0, k * 10 + 200).alias("row_stop"))


@query("s23_catalog_explode", "SELECT o_custkey::VARCHAR AS source_id, (dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS unit_ordinal, o_orderkey::VARCHAR AS unit_id, (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1)::INT AS shard_ordinal, l_linenumber::VARCHAR AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def s23(t: Tables) -> DataFrame:
    """A catalogue of customers, their orders and the lines of these, nested as a catalogue document is."""
    shards = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda d: F.struct(d.cast("string").alias("path"))).alias("shards"))
    units = F.sort_array(F.collect_list(F.struct("o_orderkey", "shards")))
    nested = t.orders.select("o_orderkey", "o_custkey").join(shards, "o_orderkey").groupBy(F.col("o_custkey").cast("string").alias("source_id"))
    return catalog.explode_catalog(nested.agg(F.transform(units, lambda u: F.struct(u["o_orderkey"].cast("string").alias("unit_id"), u["shards"].alias("shards"))).alias("units")))


@query("j01_selected_rows", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT DISTINCT item_id * 7 FROM benchmark)")
def j01(t: Tables) -> DataFrame:
    """Rows by position: a narrow scan finds where the selected ids lie, and only their row groups are read for the rest."""
    path = f"{t.sf_dir}/documents.parquet"
    at = t.spark.read.parquet(path).select("doc_id", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
    chosen = at.join(t.benchmark.select((F.col("item_id") * 7).alias("doc_id")), "doc_id", "left_semi")
    return records.read_selected(t.spark, path, chosen.drop("doc_id"), ["doc_id", "source"]).select("doc_id", "source")


@query("j02_deref_docs", f"WITH {WIDE}, x AS (SELECT row_index, unnest([row_index, row_index + 3, 5]) AS ref, unnest([0, 1, 2]) AS pos FROM wide) SELECT row_index, md5(string_agg(coalesce(text, '?'), '/' ORDER BY pos)) AS texts FROM x LEFT JOIN documents ON doc_id = ref GROUP BY row_index")
def j02(t: Tables) -> DataFrame:
    r = F.col("row_index")
    w = wide(t).select("row_index", F.array(r, r + 3, F.lit(5).cast("long")).alias("ids"))
    return corpus.dereference(w, "ids", t.documents, "row_index").select("row_index", F.md5(F.array_join("texts", "/", "?")).alias("texts"))


@query("j03_dedup_lookup", "WITH u AS (SELECT text, min(doc_id) AS first_doc FROM documents GROUP BY text) SELECT doc_id, first_doc, first_doc = doc_id AS is_new FROM documents LEFT JOIN u USING (text)")
def j03(t: Tables) -> DataFrame:
    known = t.documents.groupBy(F.sha2("text", 256).alias("digest"), "text").agg(F.min("doc_id").alias("first_doc"))
    d = t.documents.withColumn("digest", F.sha2("text", 256))
    return d.join(known, ["digest", "text"], "left").select("doc_id", "first_doc", (F.col("first_doc") == F.col("doc_id")).alias("is_new"))


_LISTS = "a AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS x FROM documents WHERE source <> 'src3' GROUP BY source), b AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS x FROM documents WHERE source <> 'src8' AND NOT (source = 'src5' AND doc_id % 2 = 1) GROUP BY source)"


@query("j04_lockstep_mismatch", f"WITH {_LISTS} SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.x IS NULL THEN 'left missing' WHEN b.x IS NULL THEN 'right missing' ELSE 'differs' END AS problem FROM a FULL JOIN b ON a.source = b.source WHERE a.x IS DISTINCT FROM b.x")
def j04(t: Tables) -> DataFrame:
    a, b = t.documents.where("source <> 'src3'"), t.documents.where("source <> 'src8' AND NOT (source = 'src5' AND doc_id % 2 = 1)")
    return catalog.lockstep_mismatch(a, b, "source", "doc_id")


@query("j05_content_keys", f"WITH {PAIRS} SELECT query_id, sha256(query) AS query_key FROM qp")
def j05(t: Tables) -> DataFrame:
    keys = pairs(t).select(F.col("query").alias("q"), F.sha2("query", 256).alias("query_key")).distinct()
    return pairs(t).join(keys, F.col("query") == F.col("q")).select("query_id", "query_key")


@query("j06_missing_references", "SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY l_partkey")
def j06(t: Tables) -> DataFrame:
    known = t.part.where("p_size > 10").select(F.col("p_partkey").alias("part"))
    return t.lineitem.select(F.col("l_partkey").alias("part")).join(known, "part", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("j08_first_passage_per_link", "WITH p AS (SELECT source, min_by(doc_id, doc_id) AS doc_id FROM documents GROUP BY source) SELECT d.doc_id AS question, p.doc_id AS passage FROM documents d JOIN p USING (source)")
def j08(t: Tables) -> DataFrame:
    first = t.documents.groupBy("source").agg(F.min("doc_id").alias("passage"))
    return t.documents.select("source", F.col("doc_id").alias("question")).join(first, "source").select("question", "passage")


@query("j09_range_overlap", f"WITH {_SHARDS} SELECT a.path, a.shard_id AS shard_a, b.shard_id AS shard_b FROM sh a JOIN sh b ON a.path = b.path AND a.shard_id < b.shard_id AND greatest(coalesce(a.row_start, 0), coalesce(b.row_start, 0)) < least(coalesce(a.row_stop, 4611686018427387904), coalesce(b.row_stop, 4611686018427387904))")
def j09(t: Tables) -> DataFrame:
    return catalog.overlaps(_shards(t))


@query("j10_profile_overrides", "SELECT source, CASE WHEN source IN ('src2', 'src9') THEN 'one,two' ELSE string_agg(DISTINCT lang, ',' ORDER BY lang) END AS units, source IN ('src2', 'src9') AS overridden FROM documents GROUP BY source")
def j10(t: Tables) -> DataFrame:
    base = t.documents.groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("units"))
    over = t.spark.createDataFrame([("src2", ["one", "two"]), ("src9", ["one", "two"])], "source string, units array<string>")
    return catalog.apply_overrides(base, over, "source").select("source", F.array_join("units", ",").alias("units"), "overridden")


@query("j11_override_coverage", f"WITH {_SHARDS} SELECT path, row_start, 'right' AS side FROM sh WHERE row_start % 70 = 0")
def j11(t: Tables) -> DataFrame:
    every = _shards(t).select("path", "row_start")
    return catalog.multiset_difference(every.where("row_start IS NULL OR row_start % 70 <> 0"), every)


@query("j12_manifest_merge", "WITH o AS (SELECT source, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY source), w AS (SELECT source, count(*) * 2 AS n FROM documents WHERE source IN ('src1', 'src3') GROUP BY source) SELECT coalesce(w.source, o.source) AS source, coalesce(w.n, o.n) AS n, w.source IS NOT NULL AS rebuilt FROM o FULL JOIN w ON o.source = w.source")
def j12(t: Tables) -> DataFrame:
    n = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return catalog.merge_manifest(n.where("source <> 'src3'"), n.where("source IN ('src1', 'src3')").withColumn("n", F.col("n") * 2), "source")


_OFF = "o AS (SELECT source AS unit, lang AS shard_id, sum(c) OVER (PARTITION BY source ORDER BY lang)::BIGINT AS hi, (sum(c) OVER (PARTITION BY source ORDER BY lang) - c)::BIGINT AS lo FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL))"


def _offsets(t: Tables) -> DataFrame:
    c = t.documents.groupBy(F.col("source").alias("unit"), F.col("lang").alias("shard_id")).agg(F.count(F.lit(1)).alias("c"))
    return catalog.offsets(c, "unit", ["shard_id"], "c").drop("c")


@query("w02_cumulative_offsets", f"WITH {_OFF} SELECT unit, shard_id, lo, hi FROM o")
def w02(t: Tables) -> DataFrame:
    return _offsets(t).select("unit", "shard_id", "lo", "hi")


@query("j13_logical_row_location", f"WITH {_OFF}, q AS (SELECT source AS unit, row_number() OVER (PARTITION BY source ORDER BY doc_id) * 3 - 3 AS logical FROM documents) SELECT q.unit, logical, shard_id, logical - lo AS inner_row FROM q JOIN o ON q.unit = o.unit AND logical >= lo AND logical < hi")
def j13(t: Tables) -> DataFrame:
    q = corpus.dense_ids(t.documents.select(F.col("source").alias("unit"), "doc_id"), ["doc_id"], "k", ["unit"]).select("unit", (F.col("k") * 3).alias("logical"))
    return catalog.locate(q, _offsets(t), "unit", "logical")


@query("j14_row_group_location", "SELECT doc_id, doc_id // 128 AS row_group, doc_id % 128 AS inner_row FROM documents")
def j14(t: Tables) -> DataFrame:
    groups = t.documents.agg(F.max("doc_id").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.expr("m div 128"))).alias("shard_id"))
    groups = groups.select(F.lit("f").alias("unit"), "shard_id", (F.col("shard_id") * 128).alias("lo"), (F.col("shard_id") * 128 + 128).alias("hi"))
    rows = t.documents.select(F.lit("f").alias("unit"), "doc_id")
    return catalog.locate(rows, groups, "unit", "doc_id").select("doc_id", F.col("shard_id").alias("row_group"), "inner_row")


@query("j16_conversion_star", f"WITH {PAIRS} SELECT query_id, role, length(passage) AS n FROM qp JOIN conversations c ON qp.conv_id = c.conv_id AND c.turn = 0 JOIN labels l ON l.doc_id = qp.conv_id WHERE quality = 1")
def j16(t: Tables) -> DataFrame:
    first = t.conversations.where("turn = 0").select("conv_id", "role")
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return pairs(t).join(first, "conv_id").join(good, "conv_id").select("query_id", "role", F.length("passage").cast("long").alias("n"))


@query("j17_ranked_documents", "WITH x AS (SELECT doc_id, [doc_id + 1, doc_id + 2, doc_id * 2] AS ids FROM documents), e AS (SELECT doc_id, unnest(ids) AS ref FROM x) SELECT e.doc_id, count(*) AS n FROM e LEFT JOIN documents d ON d.doc_id = ref GROUP BY e.doc_id HAVING bool_and(d.doc_id IS NOT NULL)")
def j17(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return corpus.known_lists(t.documents.select("doc_id", F.array(d + 1, d + 2, d * 2).alias("ids")), "doc_id", "ids", t.documents)


@query(
    "j18_partition_negatives",
    f"WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents), d AS (SELECT doc_id, lang, (i + 1 + {md5_number("concat_ws('|', k, doc_id)")} % (n - 1)) % n AS j FROM r, (SELECT unnest([0, 1]) AS k) WHERE n > 1) SELECT DISTINCT d.doc_id, r.doc_id AS negative FROM d JOIN r ON r.lang = d.lang AND r.i = j",
)
def j18(t: Tables) -> DataFrame:
    return sampling.partition_negatives(t.documents, "lang", "doc_id", 2)


@query("j19_state_alignment", "WITH k AS (SELECT l_returnflag AS model, l_linenumber AS key, count(*) AS shape FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber = 7) GROUP BY ALL) SELECT key::INT AS key, count(*) AS n_models, count(DISTINCT shape) AS n_shapes FROM k GROUP BY key HAVING count(*) < 3 OR count(DISTINCT shape) > 1")
def j19(t: Tables) -> DataFrame:
    k = t.lineitem.where("NOT (l_returnflag = 'A' AND l_linenumber = 7)").groupBy(F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("key")).agg(F.count(F.lit(1)).alias("shape"))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n_models"), F.countDistinct("shape").alias("n_shapes")).where("n_models < 3 OR n_shapes > 1")


@query("j19_first_differences", "WITH k AS (SELECT l_returnflag AS m, l_linenumber AS key, count(*) AS shape FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linenumber = 7) GROUP BY ALL), a AS (SELECT l.key, (SELECT shape FROM k WHERE m = 'N' AND key = l.key) AS n, (SELECT shape FROM k WHERE m = 'A' AND key = l.key) AS a, (SELECT shape FROM k WHERE m = 'R' AND key = l.key) AS r FROM (SELECT DISTINCT key FROM k) l) SELECT key::INT AS key, CASE WHEN n IS NULL THEN 'N lacks it' WHEN a IS NULL THEN 'A lacks it' WHEN a <> n THEN 'A has shape ' || a || ', not ' || n WHEN r IS NULL THEN 'R lacks it' WHEN r <> n THEN 'R has shape ' || r || ', not ' || n END AS problem FROM a WHERE n IS NULL OR a IS NULL OR r IS NULL OR a <> n OR r <> n")
def j19b(t: Tables) -> DataFrame:
    """Where three states don't agree with the first of them, and how."""
    state = lambda m: t.lineitem.where(F.col("l_returnflag") == m).where("NOT (l_returnflag = 'A' AND l_linenumber = 7)").groupBy(F.col("l_linenumber").alias("key")).agg(F.count(F.lit(1)).alias("shape"))
    return checks.differences({m: state(m) for m in ("N", "A", "R")}, "key", ["shape"])


@query("j20_side_pairing", "SELECT o_custkey AS prefix, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END) AS a, max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END) AS b, CASE WHEN count(*) FILTER (o_orderkey % 2 = 0) = 0 THEN 'no a' WHEN count(*) FILTER (o_orderkey % 2 = 1) = 0 THEN 'no b' WHEN count(*) > 2 THEN 'repeated' END AS problem FROM orders GROUP BY o_custkey")
def j20(t: Tables) -> DataFrame:
    """Pairs with what is wrong with them; complete_pairs makes that an error."""
    o = t.orders.select(F.col("o_custkey").alias("prefix"), F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("b").alias("side"), "o_orderkey")
    return catalog.side_pairs(o, "prefix", "side", "o_orderkey")


@query("j21_prioritised_keys", "WITH c AS (SELECT doc_id, unnest([doc_id * 3, doc_id + 7, doc_id]) AS cand, unnest([1, 2, 3]) AS pri FROM documents) SELECT c.doc_id, min_by(cand, pri) AS resolved FROM c JOIN labels l ON l.doc_id = cand GROUP BY c.doc_id")
def j21(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return catalog.first_match(t.documents.select("doc_id", F.array(d * 3, d + 7, d).alias("c")), "doc_id", "c", t.labels, "doc_id")


@query("j22_unordered_pairs", "SELECT a.n_nationkey AS i, b.n_nationkey AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def j22(t: Tables) -> DataFrame:
    return catalog.unordered_pairs(t.nation, "n_nationkey")


@query("j23_result_comparison", "WITH a AS (SELECT event_type AS k, count(*) AS n FROM events WHERE event_id % 2 = 0 AND event_type <> 'error' GROUP BY event_type), b AS (SELECT event_type AS k, count(*) AS n FROM events WHERE event_id % 2 = 1 AND event_type <> 'click' GROUP BY event_type) SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n, a.n IS NOT DISTINCT FROM b.n AS same FROM a FULL JOIN b ON a.k = b.k")
def j23(t: Tables) -> DataFrame:
    n = lambda c: t.events.where(c).groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    j = catalog.compare_results(n("event_id % 2 = 0 AND event_type <> 'error'"), n("event_id % 2 = 1 AND event_type <> 'click'"), ["k"], "n", [])
    return j.select("k", "left_n", "right_n", F.col("left_n").eqNullSafe(F.col("right_n")).alias("same"))


_RUN = "SELECT event_type AS task, user_id % 7 AS split, CASE WHEN user_id % 11 > 0 THEN user_id % 11 END AS subset, max(user_id) AS score, max(event_id) % 2 AS revision, count(*) AS n FROM events WHERE {} GROUP BY ALL"


@query(
    "j23_audited_results",
    f"WITH a AS ({_RUN.format('event_id % 3 < 2')}), b AS ({_RUN.format('event_id % 3 > 0')}) SELECT coalesce(a.task, b.task) AS task, coalesce(a.split, b.split) AS split, coalesce(a.subset, b.subset) AS subset, a.score AS left_score, b.score AS right_score, b.score - a.score AS delta, CASE WHEN a.n IS NULL THEN 'right' WHEN b.n IS NULL THEN 'left' ELSE 'both' END AS found, a.revision AS left_revision, b.revision AS right_revision, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN a.revision = b.revision END AS same_revision, a.n AS left_n, b.n AS right_n, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN a.n = b.n END AS same_n FROM a FULL JOIN b ON a.task = b.task AND a.split = b.split AND a.subset IS NOT DISTINCT FROM b.subset",
)
def j23_audited(t: Tables) -> DataFrame:
    """Results of two runs by task, split and subset (null: the whole), with the revision and number of rows of each."""
    user = F.col("user_id")
    keys = [F.col("event_type").alias("task"), (user % 7).alias("split"), F.when(user % 11 > 0, user % 11).alias("subset")]
    run = lambda c: t.events.where(c).groupBy(*keys).agg(F.max("user_id").alias("score"), (F.max("event_id") % 2).alias("revision"), F.count(F.lit(1)).alias("n"))
    return catalog.compare_results(run("event_id % 3 < 2"), run("event_id % 3 > 0"), ["task", "split", "subset"], "score", ["revision", "n"])


@query("j24_metadata_equality", "WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY source), b AS (SELECT source, count(*) + CASE WHEN source = 'src7' THEN 1 ELSE 0 END AS n FROM documents GROUP BY source) SELECT source, a.n AS stored, b.n AS expected FROM a JOIN b USING (source) WHERE a.n <> b.n")
def j24(t: Tables) -> DataFrame:
    n = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    e = n.withColumn("n", F.col("n") + F.when(F.col("source") == "src7", 1).otherwise(0))
    return checks.metadata_problems(n, e, "source", ["n"]).select("source", F.col("stored").cast("long").alias("stored"), F.col("expected").cast("long").alias("expected"))


@query("w13_contiguity", "WITH f AS (SELECT doc_id, lang, CASE WHEN lag(lang) OVER (ORDER BY doc_id) = lang THEN 0 ELSE 1 END AS c FROM documents) SELECT lang, sum(c)::BIGINT AS n_islands FROM f GROUP BY lang")
def w13(t: Tables) -> DataFrame:
    return catalog.islands(t.documents, "lang", "doc_id")


@query("a19_contiguous_groups", "WITH f AS (SELECT *, CASE WHEN lag(conv_id) OVER (ORDER BY conv_id, turn) = conv_id THEN 0 ELSE 1 END AS c FROM conversations) SELECT conv_id, sum(c)::BIGINT = 1 AS contiguous, string_agg(role, ',' ORDER BY turn) AS roles FROM f GROUP BY conv_id")
def a19(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "role", F.struct("conv_id", "turn").alias("o"))
    groups = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))
    return catalog.islands(c, "conv_id", "o").join(groups, "conv_id").select("conv_id", (F.col("n_islands") == 1).alias("contiguous"), "roles")


@query("w01_dense_query_ids", f"WITH {WIDE} SELECT unit, row_index, row_number() OVER (PARTITION BY unit ORDER BY row_index) - 1 AS query_id FROM wide WHERE query IS NOT NULL AND query <> '' AND passage IS NOT NULL AND passage <> ''")
def w01(t: Tables) -> DataFrame:
    v = corpus.valid_rows(wide(t), "query", "passage").select("unit", "row_index")
    return corpus.dense_ids(v, ["row_index"], "query_id", ["unit"])


_MANIFESTS = "m AS (SELECT source, 1 + (substr(source, 4)::INT % 5 = 4)::INT AS format_version, CASE WHEN substr(source, 4)::INT % 3 = 2 THEN 'other' ELSE 'compact' END AS source_dataset, CASE WHEN substr(source, 4)::INT % 2 = 0 THEN 'r1' END AS source_revision FROM documents GROUP BY source)"


@query("p24_manifest_gate", f"WITH {_MANIFESTS} SELECT source, CASE WHEN format_version <> 1 THEN 'format version' WHEN source_dataset <> 'compact' THEN 'dataset' WHEN source_revision IS DISTINCT FROM 'r1' THEN 'revision' END AS problem FROM m WHERE format_version <> 1 OR source_dataset <> 'compact' OR source_revision IS DISTINCT FROM 'r1'")
def p24(t: Tables) -> DataFrame:
    """Manifests that the gate turns away, and why; those that remain pass it."""
    n = F.substring("source", 4, 9).cast("int")
    m = t.documents.select("source").distinct()
    m = m.select("source", (1 + (n % 5 == 4).cast("int")).alias("format_version"), F.when(n % 3 == 2, "other").otherwise("compact").alias("source_dataset"), F.when(n % 2 == 0, "r1").alias("source_revision"))
    bad = checks.manifest_problems(m, 1, "compact", "r1").select("source", "problem")
    checks.assert_manifest(m.join(bad, "source", "left_anti"), 1, "compact", "r1")
    return bad
