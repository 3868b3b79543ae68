"""Queries on candidates, impressions, ranking metrics and score roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import metrics
from quern.plans.declare import Tables, query
from quern.session import materialise

# Scores of every fiftieth vector as a query against all other vectors; relevant: the same label.
_SCORES = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS ql FROM embeddings WHERE vec_id % 50 = 0), sc AS (SELECT query_id, vec_id AS doc_id, round(list_dot_product(qv, embedding::DOUBLE[]), 6) AS score, (label = ql)::INT AS rel FROM q, embeddings WHERE vec_id <> query_id), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc), nr AS (SELECT query_id, sum(rel)::BIGINT AS n_relevant FROM sc GROUP BY query_id)"


def _sides(t: Tables, *columns: str) -> tuple[DataFrame, DataFrame]:
    q, d = (t.embeddings.select(F.col("vec_id").alias(name), F.col("embedding").alias("v"), *columns) for name in ("query_id", "doc_id"))
    return q.where("query_id % 50 = 0"), d


def _scores(t: Tables, k: int | None = None, *columns: str) -> DataFrame:
    return metrics.blocked_scores(*_sides(t, *columns), k, digits=6).where("query_id <> doc_id")


@query("j15_similarity", f"WITH {_SCORES} SELECT query_id, doc_id, score FROM sc")
def j15(t: Tables) -> DataFrame:
    """The result is a row for each pair, hence quadratic; nothing else is, as pairs go from the task that scores them to the result."""
    return _scores(t)


@query("t06_candidate_topk", f"WITH {_SCORES} SELECT query_id, doc_id, score, rank::INT AS rank FROM rk WHERE rank <= 10")
def t06(t: Tables) -> DataFrame:
    # one more than k, as the query itself is among the best
    return metrics.top_k(_scores(t, 11), "query_id", "doc_id", "score", 10)


@query(
    "a29_ranking_metrics",
    f"WITH {_SCORES}, tp AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS h FROM rk WHERE rank <= 10), pq AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, sum(rel * h / rank) AS ap, sum(rel) AS hits, min(CASE WHEN rel > 0 THEN rank END) AS first FROM tp GROUP BY query_id), ideal AS (SELECT query_id, n_relevant, (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, 11)) AS i) WHERE i <= n_relevant) AS idcg FROM nr WHERE n_relevant > 0) SELECT query_id, round(dcg / idcg, 6) AS ndcg, round(ap / least(n_relevant, 10), 6) AS map, round(hits / n_relevant, 6) AS recall, round(hits / 10, 6) AS precision, round(coalesce(1 / first, 0), 6) AS mrr, (hits > 0)::INT AS hit FROM ideal JOIN pq USING (query_id)",
)
def a29(t: Tables) -> DataFrame:
    of_label = t.embeddings.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    n = t.embeddings.where("vec_id % 50 = 0").join(of_label, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    out = metrics.ranking(metrics.top_k(_scores(t, 11, "label"), "query_id", "doc_id", "score", 10), "query_id", "rel", n, 10)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "map", "recall", "precision", "mrr")), "hit")


_AUC = "(" + " + ".join(f"0.05 * ({{0}}[{i}] + {{0}}[{i + 1}])" for i in range(1, 10)) + ")"
_CURVE = "list(v ORDER BY k)"


@query(
    "a29_nauc",
    f"WITH {_SCORES}, tp AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS h FROM rk WHERE rank <= 10), pq AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, sum(rel * h / rank) AS ap, sum(rel) AS hits, min(CASE WHEN rel > 0 THEN rank END) AS first, max(score) AS max, stddev_pop(score) AS std, max(score) - max(CASE WHEN rank = 2 THEN score END) AS diff1 FROM tp GROUP BY query_id), ideal AS (SELECT query_id, n_relevant, (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, 11)) AS i) WHERE i <= n_relevant) AS idcg FROM nr WHERE n_relevant > 0), m AS (SELECT query_id, max, std, diff1, round(dcg / idcg, 6) AS ndcg, round(ap / least(n_relevant, 10), 6) AS map, round(hits / n_relevant, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr FROM ideal JOIN pq USING (query_id)), "
    "u AS (UNPIVOT m ON ndcg, map, recall, mrr INTO NAME metric VALUE y), x AS (UNPIVOT (SELECT query_id, metric, y, max, std, diff1, y AS self FROM u) ON max, std, diff1, self INTO NAME confidence VALUE c), r AS (SELECT metric, confidence, y, row_number() OVER (PARTITION BY metric, confidence ORDER BY c, query_id) - 1 AS place, count(*) OVER (PARTITION BY metric, confidence) AS n FROM x), "
    "cv AS (SELECT metric, confidence, k, avg(y) AS v FROM r, (SELECT unnest(range(0, 10)) AS k) WHERE place >= least(round_even(k / 10.0 * n, 0), n - 1) GROUP BY ALL), l AS (SELECT metric, confidence, " + _CURVE + " AS v FROM cv GROUP BY ALL), "
    "b AS (SELECT metric, v[1] * 0.9 AS flat, " + _AUC.format("v") + " AS best FROM l WHERE confidence = 'self') SELECT metric, confidence, CASE WHEN abs(best - flat) > 1e-12 THEN round((" + _AUC.format("v") + " - flat) / (best - flat), 6) END AS nauc FROM l JOIN b USING (metric) WHERE confidence <> 'self'",
)
def a29c(t: Tables) -> DataFrame:
    """Normalised area under the abstention curve of each metric at 10, for three confidences of a query's scores."""
    top = materialise(metrics.top_k(_scores(t, 11, "label"), "query_id", "doc_id", "score", 10), "top")
    of_label = t.embeddings.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    n = t.embeddings.where("vec_id % 50 = 0").join(of_label, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    names = ["ndcg", "map", "recall", "mrr"]
    per = metrics.ranking(top, "query_id", "rel", n, 10).select("query_id", *(F.round(c, 6).alias(c) for c in names))
    return metrics.nauc(per.join(metrics.confidences(top, "query_id", "score"), "query_id"), "query_id", names, ["max", "std", "diff1"])


@query("a29_best_subquery", f"WITH {_SCORES} SELECT query_id // 150 AS base_id, max(CASE WHEN rel = 1 THEN 1 / rank ELSE 0 END) AS best_rr FROM (SELECT query_id, rel, rank FROM rk WHERE rank <= 10) GROUP BY query_id // 150")
def a29b(t: Tables) -> DataFrame:
    r = metrics.top_k(_scores(t, 11, "label"), "query_id", "doc_id", "score", 10)
    return r.groupBy(F.expr("query_id div 150").alias("base_id")).agg(F.max(F.when(F.col("rel") == 1, 1 / F.col("rank")).otherwise(0.0)).alias("best_rr"))


@query("a30_leaderboard", "WITH r AS (SELECT source AS model, lang AS type, avg(quality) AS s FROM documents JOIN labels USING (doc_id) GROUP BY ALL), p AS (SELECT model, max(CASE WHEN type = 'de' THEN s END) AS de, max(CASE WHEN type = 'en' THEN s END) AS en, max(CASE WHEN type = 'es' THEN s END) AS es, max(CASE WHEN type = 'fr' THEN s END) AS fr, avg(s) AS mean FROM r GROUP BY model) SELECT model, round(de, 6) AS de, round(en, 6) AS en, round(es, 6) AS es, round(fr, 6) AS fr, round(mean, 6) AS mean, rank() OVER (ORDER BY round(mean, 6) DESC)::INT AS rank FROM p")
def a30(t: Tables) -> DataFrame:
    r = t.documents.join(t.labels, "doc_id").groupBy(F.col("source").alias("model"), "lang").agg(F.avg("quality").alias("s"))
    p = r.groupBy("model").pivot("lang").agg(F.first("s"))  # a column for each type that results name
    p = p.join(r.groupBy("model").agg(F.avg("s").alias("mean")), "model")
    p = p.select("model", *(F.round(c, 6).alias(c) for c in p.columns if c != "model"))
    return p.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean"))))


@query("a31_proxy_eval", f"WITH {_SCORES}, m AS (SELECT query_id, max(CASE WHEN rel = 1 THEN score END) AS pos, max(CASE WHEN rel = 0 THEN score END) AS neg, min(CASE WHEN rel = 1 THEN rank END) AS first FROM rk GROUP BY query_id) SELECT round(avg((first = 1)::INT), 6) AS hit_at_1, round(avg(1 / first), 6) AS mrr, round(avg(pos - neg), 6) AS margin FROM m")
def a31(t: Tables) -> DataFrame:
    """The rank of the best positive is one more than the number of documents before it, so nothing is sorted."""
    m = metrics.first_relevant(*_sides(t, "label"), digits=6)
    return m.agg(F.round(F.avg((F.col("first") == 1).cast("int")), 6).alias("hit_at_1"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"), F.round(F.avg(F.col("pos") - F.col("neg")), 6).alias("margin"))


# Impressions: sub-queries of a conversation with its candidates; every seventh conversation has a mismatch.
_IMP = "im AS (SELECT conv_id::VARCHAR AS base_id, conv_id || '_' || turn AS query_id, turn, CASE WHEN conv_id % 7 = 0 AND turn = 1 THEN '9,9' ELSE conv_id || ',' || (conv_id + 1) || ',' || (conv_id + 1) END AS cands FROM conversations)"


def _impressions(t: Tables) -> DataFrame:
    c = F.col("conv_id")
    cands = F.when((c % 7 == 0) & (F.col("turn") == 1), F.array(F.lit(9).cast("long"), F.lit(9).cast("long"))).otherwise(F.array(c, c + 1, c + 1))
    q = t.conversations.select(F.concat_ws("_", c.cast("string"), F.col("turn").cast("string")).alias("query_id"), "turn", cands.alias("cands"))
    return q.withColumn("base_id", F.regexp_extract("query_id", "^(.+)_([0-9]+)$", 1))


@query("a20_impressions", f"WITH {_IMP} SELECT base_id, count(*) AS n_subqueries, count(DISTINCT cands) = 1 AS consistent, string_agg(query_id, ' ' ORDER BY turn) AS query_ids FROM im GROUP BY base_id")
def a20(t: Tables) -> DataFrame:
    g = _impressions(t).groupBy("base_id").agg(F.count(F.lit(1)).alias("n_subqueries"), (F.countDistinct("cands") == 1).alias("consistent"), F.sort_array(F.collect_list(F.struct("turn", "query_id"))).alias("q"))
    return g.select("base_id", "n_subqueries", "consistent", F.array_join(F.transform("q", lambda x: x["query_id"]), " ").alias("query_ids"))


@query("f09_base_query_id", f"WITH {_IMP} SELECT query_id, base_id FROM im")
def f09(t: Tables) -> DataFrame:
    return _impressions(t).select("query_id", "base_id")


@query("j07_impression_scores", "WITH x AS (SELECT conv_id, unnest([conv_id, conv_id + 1]) AS cand FROM conversations WHERE turn = 0) SELECT conv_id, cand, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM x JOIN embeddings a ON a.vec_id = conv_id JOIN embeddings b ON b.vec_id = cand")
def j07(t: Tables) -> DataFrame:
    c = F.col("conv_id")
    x = t.conversations.where("turn = 0").select("conv_id", F.explode(F.array(c, c + 1)).alias("cand"))
    e = lambda k, v: t.embeddings.select(F.col("vec_id").alias(k), F.col("embedding").alias(v))
    return x.join(e("conv_id", "a"), "conv_id").join(e("cand", "b"), "cand").select("conv_id", "cand", F.round(V.dot(F.col("a"), F.col("b")), 6).alias("score"))


# Results: a score per source and language; expected tasks include some that are missing.
_RES = "res AS (SELECT source AS task, lang AS subset, avg(quality)::DOUBLE AS score, CASE WHEN lang = 'es' THEN NULL ELSE count(*)::DOUBLE END AS seconds FROM documents JOIN labels USING (doc_id) GROUP BY source, lang)"


def _results(t: Tables) -> DataFrame:
    r = t.documents.join(t.labels, "doc_id").groupBy(F.col("source").alias("task"), F.col("lang").alias("subset"))
    return r.agg(F.avg("quality").alias("score"), F.count(F.lit(1)).cast("double").alias("n")).withColumn("seconds", F.when(F.col("subset") != "es", F.col("n"))).drop("n")


@query("a12_subset_mean", f"WITH {_RES} SELECT task, round(avg(score), 6) AS score, CASE WHEN count(seconds) = count(*) THEN sum(seconds) ELSE 99.0 END AS seconds FROM res GROUP BY task")
def a12(t: Tables) -> DataFrame:
    return _results(t).groupBy("task").agg(F.round(F.avg("score"), 6).alias("score"), F.when(F.count("seconds") == F.count(F.lit(1)), F.sum("seconds")).otherwise(99.0).alias("seconds"))


@query("a13_category_scores", f"WITH {_RES}, m AS (SELECT task, avg(score) AS score, sum(seconds) AS seconds FROM res GROUP BY task), tk AS (SELECT source AS task, 'c' || (regexp_extract(source, '([0-9]+)$', 1)::INT % 3) AS category FROM documents GROUP BY source UNION ALL SELECT source || '-new', 'new' FROM documents GROUP BY source) SELECT category, count(*) AS n_tasks, count(*) FILTER (score IS NULL) AS n_missing, round(avg(coalesce(score, 0)), 6) AS score, round(sum(coalesce(seconds, 0)), 6) AS seconds FROM tk LEFT JOIN m USING (task) GROUP BY category")
def a13(t: Tables) -> DataFrame:
    """Tasks are those that documents name, and as many that have no result yet."""
    source = t.documents.select(F.col("source").alias("task")).distinct()
    number = F.regexp_extract("task", "([0-9]+)$", 1).cast("int")
    tasks = source.withColumn("category", F.concat(F.lit("c"), (number % 3).cast("string"))).unionByName(source.select(F.concat("task", F.lit("-new")).alias("task"), F.lit("new").alias("category")))
    m = _results(t).groupBy("task").agg(F.avg("score").alias("score"), F.sum("seconds").alias("seconds"))
    return metrics.category_scores(m, tasks)


@query("a14_subset_pivot", f"WITH {_RES} SELECT task, round(coalesce(max(CASE WHEN subset = 'de' THEN score END), 0), 6) AS de, round(coalesce(max(CASE WHEN subset = 'en' THEN score END), 0), 6) AS en, round(coalesce(max(CASE WHEN subset = 'es' THEN score END), 0), 6) AS es, round(coalesce(max(CASE WHEN subset = 'fr' THEN score END), 0), 6) AS fr FROM res GROUP BY task")
def a14(t: Tables) -> DataFrame:
    """A column for each subset that results name."""
    return _results(t).groupBy("task").pivot("subset").agg(F.round(F.max("score"), 6)).fillna(0.0)


@query("f14_formats", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KiB', n_chars / 1024.0) ELSE printf('%.1f MiB', n_chars / 1048576.0) END AS size, printf('%02d:%02d:%02d', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS time FROM documents")
def f14(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    size = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f KiB", F.bround(n / 1024.0, 1))).otherwise(F.format_string("%.1f MiB", F.bround(n / 1048576.0, 1)))
    return t.documents.select("doc_id", size.alias("size"), F.format_string("%02d:%02d:%02d", F.expr("n_chars div 3600"), F.expr("n_chars % 3600 div 60"), n % 60).alias("time"))
