"""Queries on sampling, validity, compilation and deduplication of training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import seeded
from quern.operators import catalog, checks, corpus, metrics, sampling
from quern.plans.declare import PAIRS, WIDE, Tables, md5_number, pairs, query, wide

_SAMPLE = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '42', 'default', source, doc_id)), doc_id) AS rk FROM documents) WHERE rk <= 20)"


# sha256 of ids in order, of a unit of up to 1024 values; above that of the digests of each 1024.
_UNIT_DIGEST = "{n}0 AS (SELECT source, k // 1024 AS b, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS d FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents WHERE {where}) GROUP BY source, b), {n} AS (SELECT source, CASE WHEN count(*) = 1 THEN min(d) ELSE sha256(string_agg(d, ',' ORDER BY b)) END AS f FROM {n}0 GROUP BY source)"


def _sample(t: Tables) -> DataFrame:
    return sampling.capped(t.documents, ["source"], F.col("doc_id"), 20)


@query(
    "flagship_capped_dedup_set",
    f"WITH {_SAMPLE}, v AS (SELECT * FROM s WHERE text IS NOT NULL AND text <> ''), c AS (SELECT source, text, min(doc_id) AS first_seen, count(*) AS refs FROM v GROUP BY source, text), i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_seen) - 1 AS id FROM c) SELECT source AS unit, sum(refs)::BIGINT AS n_rows, count(*) AS n_documents, max(id) AS max_doc_id, max(refs) AS max_refs, sum(length(text))::BIGINT AS n_chars FROM i GROUP BY source",
)
def flagship(t: Tables) -> DataFrame:
    docs = corpus.dedup(corpus.valid_rows(_sample(t), "text"), "text", "doc_id", ["source"])
    return docs.groupBy(F.col("source").alias("unit")).agg(F.sum("n_refs").alias("n_rows"), F.count(F.lit(1)).alias("n_documents"), F.max("doc_id").alias("max_doc_id"), F.max("n_refs").alias("max_refs"), F.sum(F.length("text")).alias("n_chars"))


@query("t01_capped_sample", f"WITH {_SAMPLE} SELECT source, doc_id FROM s")
def t01(t: Tables) -> DataFrame:
    return _sample(t).select("source", "doc_id")


@query("t01_pcg64_sample")
def t01_pcg(t: Tables) -> DataFrame:
    """At most 20 rows of each source, drawn by PCG64 with the source's own seed, and read at their places."""
    sizes = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    drawn = sampling.pcg64_units(sizes, "source", "n", 20, 42, "default")
    rows = corpus.dense_ids(t.documents.select("source", "doc_id"), ["doc_id"], "logical", ["source"])
    return rows.join(drawn, ["source", "logical"]).select("source", "logical", "doc_id")


@query("t02_absolute_cap", "SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id LIMIT 100")
def t02(t: Tables) -> DataFrame:
    return sampling.reservoir(t.documents.select("doc_id"), F.col("doc_id"), 100)


@query(
    "t03_factor_sample",
    "WITH d AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents), p AS (SELECT *, unnest([0, 1, 2]) AS pass FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY source, pass ORDER BY md5(concat_ws('|', '42', pass, source, doc_id)), doc_id) AS rk FROM p) SELECT source, doc_id, pass::INT AS pass FROM r WHERE rk <= floor(n * 2.5) - pass * n",
)
def t03(t: Tables) -> DataFrame:
    return sampling.factor(t.documents.select("source", "doc_id"), ["source"], F.col("doc_id"), 2.5)


@query("t04_reservoir", "SELECT page_id FROM pages ORDER BY md5(concat_ws('|', '7', page_id)), page_id LIMIT 25")
def t04(t: Tables) -> DataFrame:
    return sampling.reservoir(t.pages.select("page_id"), F.col("page_id"), 25, seed=7)


@query("t05_stratified_reservoir", "SELECT lang, doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', 'mix', doc_id)), doc_id) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '7', 'strata', lang, doc_id)), doc_id) AS rk FROM documents) WHERE rk <= 10")
def t05(t: Tables) -> DataFrame:
    s = sampling.capped(t.documents.select("lang", "doc_id"), ["lang"], F.col("doc_id"), 10, seed=7, profile="strata")
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"))), "doc_id")).cast("long"))


@query("t07_positive_choice", f"WITH g AS (SELECT conv_id, list(text ORDER BY turn) AS pos FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, pos[({md5_number("concat_ws('|', '42', conv_id)")} % len(pos))::INT + 1] AS positive FROM g")
def t07(t: Tables) -> DataFrame:
    g = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return g.select("conv_id", sampling.choose(F.transform("p", lambda x: x["text"]), seeded(42, F.col("conv_id"))).alias("positive"))


@query(
    "t08_hard_negatives",
    f"WITH {WIDE}, n AS (SELECT row_index, list_filter([negative_1, negative_2, negative_10], lambda x: x IS NOT NULL AND x <> '') AS neg FROM wide), r AS (SELECT row_index, neg, CASE WHEN len(neg) >= 4 THEN 1 ELSE ceil(4 / len(neg))::INT END AS times FROM n WHERE len(neg) > 0), u AS (SELECT row_index, neg, unnest(range(0, times * len(neg))) AS i FROM r), k AS (SELECT row_index, neg[i % len(neg) + 1] AS x, row_number() OVER (PARTITION BY row_index ORDER BY md5(concat_ws('|', {md5_number("concat_ws('|', '42', row_index)")}, i)), i) AS rk FROM u) SELECT row_index, string_agg(x, '/' ORDER BY rk) AS negatives FROM k WHERE rk <= 4 GROUP BY row_index",
)
def t08(t: Tables) -> DataFrame:
    n = corpus.nest_negatives(wide(t)).where("size(negatives) > 0")
    return n.select("row_index", F.array_join(sampling.choose_many(F.col("negatives"), 4, seeded(42, F.col("row_index"))), "/").alias("negatives"))


@query("t09_probe_negatives", f"WITH {WIDE}, n AS (SELECT row_index, list_filter([negative_1, negative_2, negative_10], lambda x: x IS NOT NULL AND x <> '') AS neg FROM wide) SELECT row_index, CASE WHEN len(neg) >= 2 THEN array_to_string(neg[1:2], '/') ELSE array_to_string([neg[({md5_number("concat_ws('|', " + md5_number("concat_ws('|', '5', row_index)") + ", i)")} % len(neg))::INT + 1] FOR i IN [1, 2]], '/') END AS negatives FROM n WHERE len(neg) > 0")
def t09(t: Tables) -> DataFrame:
    n = corpus.nest_negatives(wide(t)).where("size(negatives) > 0")
    return n.select("row_index", F.array_join(sampling.with_replacement(F.col("negatives"), 2, seeded(5, F.col("row_index"))), "/").alias("negatives"))


@query("t10_shuffled_cycles", "WITH c AS (SELECT lang, doc_id, unnest([0, 1, 2]) AS cycle FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, cycle ORDER BY md5(concat_ws('|', '42', cycle, doc_id)), doc_id) - 1 AS place, count(*) OVER (PARTITION BY lang, cycle) AS n FROM c) SELECT lang, cycle::INT AS cycle, place // 8 AS batch, doc_id FROM r WHERE place // 8 < n // 8")
def t10(t: Tables) -> DataFrame:
    sizes = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    c = t.documents.select("lang", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("cycle"))
    c = c.withColumn("h", F.md5(F.concat_ws("|", F.lit("42"), F.col("cycle").cast("string"), F.col("doc_id").cast("string"))))
    r = corpus.dense_ids(c, ["h", "doc_id"], "place", ["lang", "cycle"]).join(sizes, "lang")
    return r.withColumn("batch", F.expr("place div 8")).where("batch < n div 8").select("lang", "cycle", "batch", "doc_id")


@query("t11_first_per_language", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rk FROM documents) WHERE rk <= 100")
def t11(t: Tables) -> DataFrame:
    return t.documents.select("lang", "doc_id", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("rk")).where("rk <= 100").drop("rk")


@query("t12_hash_negatives", f"WITH {PAIRS}, c AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark), d AS (SELECT query_id, unnest([0, 1, 2]) AS k, {md5_number("concat_ws('|', '42', 'train', query_id)")} AS h, {md5_number("concat_ws('|', '43', 'train', query_id)")} AS g FROM qp) SELECT query_id, item_id FROM d JOIN c ON i = (h % n + k * (1 + g % greatest(n // 4, 1))) % n")
def t12(t: Tables) -> DataFrame:
    """Three candidates a query: a seeded start and a seeded step among dense candidate numbers, so no pairs are made."""
    c = corpus.dense_ids(t.benchmark.select("item_id"), ["item_id"], "i")
    q = pairs(t).select("query_id", seeded(42, "train", F.col("query_id")).alias("h"), seeded(43, "train", F.col("query_id")).alias("g"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    q = q.join(F.broadcast(t.benchmark.agg(F.count(F.lit(1)).alias("n"))))  # one row
    return q.withColumn("i", F.expr("(h % n + k * (1 + g % greatest(n div 4, 1L))) % n")).join(c, "i").select("query_id", "item_id")


@query("p01_valid_rows", f"WITH {WIDE} SELECT count(*) AS selected, count(*) FILTER (query IS NOT NULL AND query <> '' AND passage IS NOT NULL AND passage <> '') AS valid, count(*) FILTER (NOT (query IS NOT NULL AND query <> '' AND passage IS NOT NULL AND passage <> '')) AS dropped FROM wide")
def p01(t: Tables) -> DataFrame:
    return corpus.drop_report(wide(t), "query", "passage")


@query("p02_filter_negatives", f"WITH {WIDE}, n AS (SELECT row_index, list_filter([negative_1, negative_2, negative_10], lambda x: x IS NOT NULL AND x <> '') AS neg FROM wide) SELECT row_index, array_to_string(neg, '/') AS negatives, (3 - len(neg))::INT AS n_removed FROM n")
def p02(t: Tables) -> DataFrame:
    return corpus.nest_negatives(wide(t)).select("row_index", F.array_join("negatives", "/").alias("negatives"), "n_removed")


@query("p03_profile_membership", "SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3', 'src5')")
def p03(t: Tables) -> DataFrame:
    enabled = t.spark.createDataFrame([("src1",), ("src3",), ("src5",)], "source string")
    return t.documents.join(enabled, "source", "left_semi").select("doc_id", "source")


@query(
    "p04_exclusion_status",
    "WITH u AS (SELECT source AS unit, max(toxic) AS tox FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT unit, CASE WHEN unit IN ('src4', 'src5') THEN 'excluded' WHEN unit IN ('src1', 'src2') THEN NULL WHEN tox = 1 THEN 'contaminated' END AS reason, (CASE WHEN unit IN ('src4', 'src5') THEN 'excluded' WHEN unit IN ('src1', 'src2') THEN NULL WHEN tox = 1 THEN 'contaminated' END) IS NOT NULL AS excluded FROM u",
)
def p04(t: Tables) -> DataFrame:
    u = t.documents.join(t.labels, "doc_id").groupBy(F.col("source").alias("unit")).agg(F.max("toxic").alias("tox"))
    return catalog.exclusion_status(u, F.col("tox") == 1, False, ["src1", "src2"], ["src4", "src5"], "unit").select("unit", "reason", "excluded")


@query("p05_only_units", "SELECT unit, (SELECT count(*) FROM documents WHERE source = unit) = 0 AS unknown FROM (VALUES ('src1'), ('src99')) AS v(unit)")
def p05(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("src1",), ("src99",)], "unit string")
    known = t.documents.select(F.col("source").alias("unit")).distinct()
    return wanted.join(known.withColumn("k", F.lit(True)), "unit", "left").select("unit", F.col("k").isNull().alias("unknown"))


@query("p06_row_range", "SELECT doc_id FROM documents WHERE doc_id >= (SELECT count(*) // 10 FROM documents) AND doc_id < (SELECT count(*) * 9 // 10 FROM documents)")
def p06(t: Tables) -> DataFrame:
    n = t.documents.count()
    return t.documents.where((F.col("doc_id") >= n // 10) & (F.col("doc_id") < n * 9 // 10)).select("doc_id")


@query("p07_enabled_default", "SELECT source, coalesce(CASE WHEN source = 'src3' THEN false WHEN source = 'src4' THEN true END, true) AS enabled FROM documents GROUP BY source")
def p07(t: Tables) -> DataFrame:
    flag = F.when(F.col("source") == "src3", False).when(F.col("source") == "src4", True)
    return t.documents.select("source").distinct().select("source", F.coalesce(flag, F.lit(True)).alias("enabled"))


@query("p08_core_projection", f"WITH {WIDE} SELECT row_index, query, passage, coalesce(lang, 'en') AS lang FROM wide")
def p08(t: Tables) -> DataFrame:
    w = wide(t)
    lang = F.coalesce("lang", F.lit("en")) if "lang" in w.columns else F.lit("en")
    return w.select("row_index", "query", "passage", lang.alias("lang"))


@query("p09_logical_alias", "SELECT doc_id, text AS query FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def p09(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_semi").withColumn("query", F.col("text")).select("doc_id", "query")


@query("p10_rename_key", "SELECT sha256(text) AS id, doc_id FROM documents")
def p10(t: Tables) -> DataFrame:
    return t.documents.select(F.sha2("text", 256).alias("query_key"), "doc_id").withColumnRenamed("query_key", "id")


@query("p11_probe_rows", f"WITH {WIDE}, n AS (SELECT row_index, len(list_filter([negative_1, negative_2, negative_10], lambda x: x IS NOT NULL AND x <> '')) AS k, passage, nullif(trim(CASE WHEN row_index % 4 = 0 THEN '  ' ELSE lang END), '') AS prompt FROM wide) SELECT row_index, prompt FROM n WHERE k > 0 AND passage IS NOT NULL AND passage <> ''")
def p11(t: Tables) -> DataFrame:
    n = corpus.valid_rows(corpus.nest_negatives(wide(t)), "passage").where("size(negatives) > 0")
    return n.select("row_index", F.nullif(F.trim(F.when(F.col("row_index") % 4 == 0, "  ").otherwise(F.col("lang"))), F.lit("")).alias("prompt"))


@query("p12_conversion_filters", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality >= 1 AND toxic = 0 AND text LIKE '%the%' AND lang = 'en'")
def p12(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").where("quality >= 1 AND toxic = 0 AND text LIKE '%the%' AND lang = 'en'").select("doc_id")


@query("p13_coalesced_text", f"WITH {WIDE} SELECT row_index, coalesce(nullif(query, ''), passage, '') AS query, concat_ws(' ', nullif(query, ''), passage) AS text FROM wide")
def p13(t: Tables) -> DataFrame:
    q = F.nullif(F.col("query"), F.lit(""))
    return wide(t).select("row_index", F.coalesce(q, "passage", F.lit("")).alias("query"), F.concat_ws(" ", q, "passage").alias("text"))


@query("p14_task_domain", "SELECT DISTINCT event_type AS task_type FROM events WHERE event_type NOT IN ('retrieval', 'clustering', 'classification')")
def p14(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("task_type")).distinct().where(~F.col("task_type").isin(*checks.TASK_TYPES))


@query("p15_uniqueness", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def p15(t: Tables) -> DataFrame:
    return checks.duplicates(t.documents, "text")


@query("p16_index_violations", "SELECT source, doc_id, n_chars, previous FROM (SELECT source, doc_id, n_chars, lag(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS previous FROM documents) WHERE n_chars < 0 OR (previous IS NOT NULL AND n_chars <= previous) OR n_chars >= 20000")
def p16(t: Tables) -> DataFrame:
    return checks.index_violations(t.documents.select("source", "doc_id", "n_chars"), "source", "n_chars", "doc_id", F.lit(20000))


@query(
    "p17_reranking_tasks",
    "WITH t AS (SELECT event_id, event_type AS type, 'u' || user_id AS path, CASE WHEN event_id % 5 > 0 THEN 'r' || (event_id % 5) END AS revision, CASE WHEN event_id % 2 = 0 THEN 'default' ELSE 's' || (event_id % 3) END AS subset FROM events), l AS (SELECT type, path, revision, subset FROM t UNION ALL SELECT 'a-purchase', path || '/b', revision, 'default' FROM t WHERE event_id % 3 = 0) SELECT DISTINCT path, revision, nullif(subset, 'default') AS subset FROM l WHERE type LIKE '%purchase'",
)
def p17(t: Tables) -> DataFrame:
    """Each event is a task; one in three is an aggregate of two parts."""
    i, text = F.col("event_id"), lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    e = t.events.select("event_id", F.col("event_type").alias("type"), text("u", F.col("user_id")).alias("path"), F.when(i % 5 > 0, text("r", i % 5)).alias("revision"), F.when(i % 2 == 0, "default").otherwise(text("s", i % 3)).alias("subset"))
    first = F.struct("type", "path", "revision", "subset")
    second = F.struct(F.lit("a-purchase").alias("type"), F.concat("path", F.lit("/b")).alias("path"), "revision", F.lit("default").alias("subset"))
    return catalog.task_keys(e.withColumn("parts", F.when(i % 3 == 0, F.array(first, second))), "purchase")


@query("p18_candidate_recovery", "SELECT source, max((quality = 0)::INT) = 1 AS has_negatives FROM documents JOIN labels USING (doc_id) GROUP BY source")
def p18(t: Tables) -> DataFrame:
    return corpus.has_negatives(t.documents.join(t.labels, "doc_id"), "source", "quality")


@query(
    "p18_recovered_candidates",
    "WITH q AS (SELECT source || '/' || (doc_id % 97) AS unit, doc_id, quality FROM documents JOIN labels USING (doc_id)) SELECT unit, doc_id, quality FROM q WHERE unit IN (SELECT unit FROM q GROUP BY unit HAVING count(*) FILTER (quality = 0) > 0)",
)
def p18_recovered(t: Tables) -> DataFrame:
    unit = F.concat("source", F.lit("/"), (F.col("doc_id") % 97).cast("string")).alias("unit")
    return corpus.recovered_candidates(t.documents.join(t.labels, "doc_id").select(unit, "doc_id", "quality"), "unit", "quality")


@query("p19_queries_with_positives", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality > 0)")
def p19(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where("quality > 0"), "doc_id", "left_semi").select("doc_id")


@query(
    "p20_stale_units",
    f"WITH {_UNIT_DIGEST.format(n='a', where='true')}, {_UNIT_DIGEST.format(n='b', where="NOT (source = 'src2' AND doc_id % 2 = 0)")} SELECT a.source, CASE WHEN a.source IN ('src6', 'src16') OR b.f IS NULL THEN 'missing' WHEN a.source = 'src3' THEN 'stale profile' WHEN a.source = 'src4' THEN 'stale release' WHEN a.f <> b.f THEN 'stale fingerprint' ELSE 'incomplete' END AS reason FROM a LEFT JOIN b USING (source) WHERE a.source IN ('src3', 'src4', 'src5', 'src6', 'src16') OR a.f IS DISTINCT FROM b.f",
)
def p20(t: Tables) -> DataFrame:
    """Units to build again: one has other rows, others another profile, release, no metadata or not all files."""
    src = F.col("source")
    f = lambda d: corpus.fingerprint(d, ["source"], ["doc_id"], "doc_id")
    wanted = f(t.documents).withColumns({"profile": F.lit("p"), "release": F.lit("r2")})
    stored = f(t.documents.where("NOT (source = 'src2' AND doc_id % 2 = 0)")).where(~src.isin("src6", "src16"))
    stored = stored.withColumns({"profile": F.when(src == "src3", "q").otherwise("p"), "release": F.when(src == "src4", "r1").otherwise("r2")})
    files = t.documents.select("source").distinct().withColumn("file", F.explode(F.when(src == "src5", F.array(F.lit("queries"))).otherwise(F.array(F.lit("queries"), F.lit("corpus")))))
    return catalog.stale_units(wanted, stored, files, "source", ["profile", "release", "fingerprint"], ["queries", "corpus"])


@query("p23_schema_summary", "SELECT * FROM (VALUES (0, 'row_index', 'bigint'), (1, 'unit', 'string'), (2, 'lang', 'string'), (3, 'query', 'string'), (4, 'passage', 'string'), (5, 'negative_1', 'string'), (6, 'negative_10', 'string'), (7, 'negative_2', 'string')) AS v(ordinal, name, type)")
def p23(t: Tables) -> DataFrame:
    return checks.schema_summary(wide(t)).drop("nullable")


@query("p25_missing_candidates", "SELECT c.doc_id FROM (SELECT doc_id * 2 AS doc_id FROM documents) c WHERE c.doc_id NOT IN (SELECT doc_id FROM documents)")
def p25(t: Tables) -> DataFrame:
    return t.documents.select((F.col("doc_id") * 2).alias("doc_id")).join(t.documents.select("doc_id"), "doc_id", "left_anti")


@query(
    "p26_manifest_projection",
    "WITH u AS (SELECT source, count(*) AS n, count(DISTINCT text) AS c, substr(source, 4)::INT % 2 = 0 AS whole FROM documents GROUP BY source) SELECT source AS unit_id, 'all' AS source_id, CASE WHEN whole THEN 'en' END AS language, n AS query_count, c AS corpus_count, CASE WHEN whole THEN n + 1 END AS selected_query_count, CASE WHEN whole THEN 1 END::BIGINT AS dropped_count, true AS enabled, 'units/' || source AS directory, 'units/' || source || '/queries.arrow' AS queries_path, 'units/' || source || '/corpus.arrow' AS corpus_path FROM u",
)
def p26(t: Tables) -> DataFrame:
    u = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("c"))
    base = [F.col("source").alias("unit_id"), F.lit("all").alias("source_id"), F.col("n").alias("query_count"), F.col("c").alias("corpus_count")]
    more = [F.lit("en").alias("language"), (F.col("n") + 1).alias("selected_query_count"), F.lit(1).alias("dropped_count")]
    text = F.when(F.substring("source", 4, 9).cast("int") % 2 == 0, F.to_json(F.struct(*base, *more))).otherwise(F.to_json(F.struct(*base)))
    return catalog.manifest_units(u.select(text.alias("text")), "text", ["query_count", "corpus_count"], ["selected_query_count", "dropped_count"])


@query("p27_candidate_ids", "SELECT conv_id, string_agg(conv_id || '-' || turn, ',' ORDER BY conv_id || '-' || turn) AS ids FROM conversations GROUP BY conv_id")
def p27(t: Tables) -> DataFrame:
    """Candidates given as the keys of a mapping, as an ordered list; a mapping is one query's."""
    m = t.conversations.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "role"))).alias("m"))
    return m.select("conv_id", F.array_join(F.sort_array(F.map_keys("m")), ",").alias("ids"))


@query("a01_unit_counts", f"WITH {_SAMPLE}, n AS (SELECT source, lang, count(*) AS n_rows FROM documents GROUP BY ALL), k AS (SELECT source, lang, count(*) AS n_selected FROM s GROUP BY ALL) SELECT source, lang, n_rows, coalesce(n_selected, 0) AS n_selected FROM n LEFT JOIN k USING (source, lang)")
def a01(t: Tables) -> DataFrame:
    n = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_rows"))
    k = _sample(t).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_selected"))
    return n.join(k, ["source", "lang"], "left").fillna(0, ["n_selected"])


@query("a02_task_rollup", "SELECT coalesce(lang, 'total') AS task_type, count(DISTINCT source) AS n_sources, count(*) AS n_queries FROM documents GROUP BY ROLLUP (lang)")
def a02(t: Tables) -> DataFrame:
    return t.documents.rollup("lang").agg(F.countDistinct("source").alias("n_sources"), F.count(F.lit(1)).alias("n_queries")).withColumn("task_type", F.coalesce("lang", F.lit("total"))).drop("lang")


@query("a03_distinct_counts", "SELECT count(DISTINCT source) AS n_sources, count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN source END) AS n_active, count(DISTINCT lang) AS n_units, count(DISTINCT source || lang) AS n_shards FROM documents")
def a03(t: Tables) -> DataFrame:
    return t.documents.agg(F.countDistinct("source").alias("n_sources"), F.countDistinct(F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("n_active"), F.countDistinct("lang").alias("n_units"), F.countDistinct(F.concat("source", "lang")).alias("n_shards"))


@query("a04_dense_id_check", "WITH c AS (SELECT row_number() OVER (ORDER BY min(doc_id)) - 1 AS doc_id FROM documents GROUP BY text) SELECT 'doc_id' AS id_name, count(*) AS n_rows, min(doc_id) AS min_id, max(doc_id) AS max_id, count(DISTINCT doc_id) AS n_distinct, count(*) = count(DISTINCT doc_id) AND min(doc_id) = 0 AND max(doc_id) = count(*) - 1 AS dense FROM c")
def a04(t: Tables) -> DataFrame:
    return checks.dense_id_report(corpus.dedup(t.documents, "text", "doc_id"), "doc_id")


@query("a05_reference_bounds", f"WITH {WIDE}, r AS (SELECT unnest([row_index, row_index % 10, row_index + 1]) AS ref FROM wide) SELECT min(ref) AS min_ref, max(ref) AS max_ref, count(*) AS n_refs, (SELECT count(DISTINCT row_index) FROM wide) AS n_sample_ids FROM r")
def a05(t: Tables) -> DataFrame:
    r = F.col("row_index")
    w = wide(t).select(r, F.array(r, r % 10, r + 1).alias("refs"))
    return w.agg(F.min(F.array_min("refs")).alias("min_ref"), F.max(F.array_max("refs")).alias("max_ref"), F.sum(F.size("refs")).cast("long").alias("n_refs"), F.countDistinct("row_index").alias("n_sample_ids"))


@query("a06_doc_refcounts", f"WITH {WIDE}, r AS (SELECT unnest([row_index, row_index % 10]) AS doc_id FROM wide) SELECT doc_id, count(*) AS n_refs FROM r GROUP BY doc_id")
def a06(t: Tables) -> DataFrame:
    return corpus.reference_counts(wide(t).select(F.array("row_index", F.col("row_index") % 10).alias("ids")), "ids")


@query("a07_profile_totals", "SELECT sum(q)::BIGINT AS query_count, sum(c)::BIGINT AS corpus_count FROM (SELECT source, count(*) AS q, count(DISTINCT text) AS c FROM documents GROUP BY source)")
def a07(t: Tables) -> DataFrame:
    u = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("q"), F.countDistinct("text").alias("c"))
    return u.agg(F.sum("q").alias("query_count"), F.sum("c").alias("corpus_count"))


_LEN = "SELECT lang, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n FROM documents"


@query(
    "a08_length_profile",
    f"SELECT lang, count(*) AS n, round(avg(n), 6) AS mean_len, max(n)::BIGINT AS max_len, round(avg((n > 256)::INT::DOUBLE), 6) AS share_over_256, round(avg((n > 512)::INT::DOUBLE), 6) AS share_over_512, floor(round(quantile_cont(n, 0.5), 6))::BIGINT AS p50, floor(round(quantile_cont(n, 0.9), 6))::BIGINT AS p90, floor(round(quantile_cont(n, 0.95), 6))::BIGINT AS p95, floor(round(quantile_cont(n, 0.99), 6))::BIGINT AS p99 FROM ({_LEN}) GROUP BY lang",
)
def a08(t: Tables) -> DataFrame:
    return metrics.length_profile(t.documents, F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")), ["lang"])


@query("a09_dataset_statistics", f"WITH {WIDE}, n AS (SELECT unit, len(list_filter([negative_1, negative_2, negative_10], lambda x: x IS NOT NULL AND x <> '')) AS k FROM wide) SELECT unit, count(*) AS n_samples, min(k)::INT AS min_neg, round(avg(k), 6) AS avg_neg, max(k)::INT AS max_neg FROM n GROUP BY unit")
def a09(t: Tables) -> DataFrame:
    n = corpus.nest_negatives(wide(t)).withColumn("k", F.size("negatives"))
    return n.groupBy("unit").agg(F.count(F.lit(1)).alias("n_samples"), F.min("k").alias("min_neg"), F.round(F.avg("k"), 6).alias("avg_neg"), F.max("k").alias("max_neg"))


@query("a10_schema_groups", "WITH f AS (SELECT source, min(doc_id) AS ordinal, string_agg(DISTINCT lang, ',' ORDER BY lang) AS signature FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source), g AS (SELECT signature, min(ordinal) AS first FROM f GROUP BY signature), r AS (SELECT signature, 'P' || lpad((row_number() OVER (ORDER BY first))::VARCHAR, 2, '0') AS schema_id FROM g) SELECT source, schema_id FROM f JOIN r USING (signature)")
def a10(t: Tables) -> DataFrame:
    f = t.documents.join(t.labels.where("toxic = 1"), "doc_id").groupBy("source").agg(F.min("doc_id").alias("ordinal"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("signature"))
    g = corpus.dense_ids(f.groupBy("signature").agg(F.min("ordinal").alias("first")), ["first"], "k")
    return f.join(g, "signature").select("source", F.concat(F.lit("P"), F.lpad((F.col("k") + 1).cast("string"), 2, "0")).alias("schema_id"))


@query("a11_inventory_totals", "SELECT count(DISTINCT source) AS n_files, count(*) AS n_rows, sum(n_chars)::BIGINT AS n_bytes, count(DISTINCT lang) AS n_schemas FROM documents")
def a11(t: Tables) -> DataFrame:
    return t.documents.agg(F.countDistinct("source").alias("n_files"), F.count(F.lit(1)).alias("n_rows"), F.sum("n_chars").alias("n_bytes"), F.countDistinct("lang").alias("n_schemas"))


@query("a18_pair_counts", f"WITH {WIDE}, n AS (SELECT unit, len(list_filter([negative_1, negative_2], lambda x: x IS NOT NULL AND x <> '')) AS a, row_index % 4 AS b FROM wide) SELECT unit, sum(a * b)::BIGINT AS n_pairs FROM n GROUP BY unit")
def a18(t: Tables) -> DataFrame:
    a = F.size(F.filter(F.array("negative_1", "negative_2"), corpus.is_text))
    return wide(t).groupBy("unit").agg(F.sum(a * (F.col("row_index") % 4)).alias("n_pairs"))


@query("a21_dictionary_encode", "WITH u AS (SELECT text, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY text) SELECT doc_id, code FROM documents JOIN u USING (text)")
def a21(t: Tables) -> DataFrame:
    return corpus.dictionary(t.documents, "text", "doc_id")[1]


@query("a22_dedup_corpus", "SELECT sha256(text) AS digest, min(doc_id) AS first_seen, count(*) AS n_refs, row_number() OVER (ORDER BY min(doc_id)) - 1 AS doc_id FROM documents GROUP BY text")
def a22(t: Tables) -> DataFrame:
    return corpus.dedup(t.documents, "text", "doc_id").drop("text")


@query("a23_selection_fingerprint", f"WITH {_UNIT_DIGEST.format(n='a', where='true')} SELECT source, f AS fingerprint FROM a")
def a23(t: Tables) -> DataFrame:
    return corpus.fingerprint(t.documents, ["source"], ["doc_id"], "doc_id")


@query("a27_ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def a27(t: Tables) -> DataFrame:
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.array_distinct(listed), ",").alias("roles"))


@query("a34_token_lengths", "SELECT page_id, len(regexp_extract_all(html, '[^\\x20\\x09-\\x0D]+'))::INT AS n_tokens FROM pages")
def a34(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.size(F.filter(F.split("html", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).alias("n_tokens"))


@query("u01_union_all", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def u01(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "text").unionByName(t.benchmark.select(F.col("item_id").alias("id"), "text"))


@query("u02_union_distinct", "SELECT doc_id % 50 AS id FROM documents UNION SELECT item_id FROM benchmark")
def u02(t: Tables) -> DataFrame:
    return t.documents.select((F.col("doc_id") % 50).alias("id")).union(t.benchmark.select("item_id")).distinct()


@query("u03_intersect", "SELECT doc_id AS id FROM documents INTERSECT SELECT item_id FROM benchmark")
def u03(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id")).intersect(t.benchmark.select("item_id"))


@query("u04_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u04(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id")).distinct()


@query("u05_multiset_equality", "SELECT lang, 'left' AS side FROM (SELECT lang FROM documents EXCEPT ALL SELECT lang FROM documents JOIN labels USING (doc_id))")
def u05(t: Tables) -> DataFrame:
    return catalog.multiset_difference(t.documents.select("lang"), t.documents.join(t.labels, "doc_id").select("lang"))


@query("u06_merged_negatives", f"WITH {WIDE} SELECT row_index, array_to_string(list_sort(list_distinct(list_concat([lang, unit], ['en', negative_2]))), '/') AS merged FROM wide")
def u06(t: Tables) -> DataFrame:
    return wide(t).select("row_index", F.array_join(F.sort_array(F.array_union(F.array("lang", "unit"), F.array(F.lit("en"), "negative_2"))), "/").alias("merged"))


@query("u07_last_wins_merge", "SELECT source, max_by(n_chars, doc_id) AS value FROM documents GROUP BY source")
def u07(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.max_by("n_chars", "doc_id").alias("value"))
