"""Queries on vectors: similarity, losses on given vectors, pooling, and merging of parameter vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import vectors as V
from quern.operators import corpus, merging, tensors
from quern.plans.declare import Tables, query

_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_N = "sqrt(list_dot_product({0}, {0}))"
_LSE = "(list_max({0}) + ln(list_sum(list_transform({0}, lambda x: exp(x - list_max({0}))))))"
# Groups of one query and four passages, positive first: neighbouring vectors.
_G = f"{_E}, g AS (SELECT a.vec_id, list(list_dot_product(a.v, b.v) / 0.05 ORDER BY k) AS s FROM e a JOIN (SELECT unnest([1, 2, 3, 4]) AS k) ON true JOIN e b ON b.vec_id = (a.vec_id + k) % (SELECT count(*) FROM e) GROUP BY a.vec_id)"


def _e(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))


def _groups(t: Tables) -> DataFrame:
    n = t.embeddings.count()
    a = _e(t).select("vec_id", F.col("v").alias("q"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")).withColumn("p", (F.col("vec_id") + F.col("k")) % n)
    j = a.join(_e(t).select(F.col("vec_id").alias("p"), F.col("v").alias("pv")), "p")
    s = F.sort_array(F.collect_list(F.struct("k", (V.dot(F.col("q"), F.col("pv")) / 0.05).alias("x"))))
    return j.groupBy("vec_id").agg(F.transform(s, lambda z: z["x"]).alias("s"))


@query("v01_normalise", f"WITH {_E} SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x / {_N.format('v')}))), 6) AS l1 FROM e")
def v01(t: Tables) -> DataFrame:
    return _e(t).select("vec_id", F.round(V.total(F.transform(V.normalise(F.col("v")), F.abs)), 6).alias("l1"))


@query("v02_scores", f"WITH {_E} SELECT a.vec_id, round(list_dot_product(a.v, b.v) / 0.05, 6) AS score FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def v02(t: Tables) -> DataFrame:
    a, b = _e(t), _e(t).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.dot(F.col("v"), F.col("w")) / 0.05, 6).alias("score"))


@query("v03_pairwise_similarity", f"WITH {_E} SELECT a.vec_id, round(list_dot_product(a.v, b.v) / ({_N.format('a.v')} * {_N.format('b.v')}), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 2")
def v03(t: Tables) -> DataFrame:
    a, b = _e(t), _e(t).select((F.col("vec_id") - 2).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


@query("v04_pooling", f"WITH {_E} SELECT vec_id, round(list_sum(v[1:8]), 6) AS cls, round(list_sum(v[1:56 + CASE WHEN vec_id % 2 = 0 THEN 8 ELSE 0 END]) / (7 + (vec_id % 2 = 0)::INT), 6) AS mean, round(CASE WHEN vec_id % 2 = 0 THEN list_sum(v[57:64]) ELSE list_sum(v[49:56]) END, 6) AS last FROM e")
def v04(t: Tables) -> DataFrame:
    """Vectors as eight tokens of eight components, the last one masked in every other; sums of the pooled components."""
    tokens = F.array(*(F.slice("v", i, 8) for i in range(1, 65, 8)))
    mask = F.array(*[F.lit(1)] * 7, (F.col("vec_id") % 2 == 0).cast("int"))
    of = lambda m: F.round(V.total(V.pool(tokens, mask, m)), 6).alias(m)
    return _e(t).select("vec_id", of("cls"), of("mean"), of("last"))


@query("v05_mean_nll", f"WITH {_G} SELECT round(avg({_LSE.format('s')} - s[1]), 6) AS loss FROM g")
def v05(t: Tables) -> DataFrame:
    return _groups(t).agg(F.round(F.avg(V.nll(F.col("s"), F.lit(0))), 6).alias("loss"))


@query("v06_explicit_group_loss", f"WITH {_G} SELECT vec_id, round({_LSE.format('s')} - s[1], 6) AS loss FROM g")
def v06(t: Tables) -> DataFrame:
    return _groups(t).select("vec_id", F.round(V.nll(F.col("s"), F.lit(0)), 6).alias("loss"))


# In-batch scores: steps of 8 queries, each against all passages of its step (positive: own vector + 1).
_BATCH = "b AS (SELECT a.vec_id, a.vec_id // 8 AS step, list(list_dot_product(a.v, p.v) / 0.05 ORDER BY p.vec_id) AS s FROM e a JOIN e p ON p.vec_id // 8 = a.vec_id // 8 GROUP BY a.vec_id)"
_B = f"{_E}, {_BATCH}"


def _batch(t: Tables) -> DataFrame:
    a = _e(t).select("vec_id", F.expr("vec_id div 8").alias("step"), F.col("v").alias("q"))
    j = a.join(_e(t).select(F.expr("vec_id div 8").alias("step"), F.col("vec_id").alias("p"), F.col("v").alias("pv")), "step")
    s = F.sort_array(F.collect_list(F.struct("p", (V.dot(F.col("q"), F.col("pv")) / 0.05).alias("x"))))
    return j.groupBy("step", "vec_id").agg(F.transform(s, lambda z: z["x"]).alias("s"))


@query("v07_in_batch_loss", f"WITH {_B} SELECT step, round(avg({_LSE.format('s')} - s[vec_id % 8 // 4 * 4 + 1]), 6) AS loss FROM b GROUP BY step")
def v07(t: Tables) -> DataFrame:
    target = F.expr("(vec_id % 8) div 4 * 4").cast("int")
    return _batch(t).groupBy("step").agg(F.round(F.avg(V.nll(F.col("s"), target)), 6).alias("loss"))


@query("v08_two_term_loss", f"WITH {_G}, h AS (SELECT avg({_LSE.format('s')} - s[1]) AS hard FROM g), {_BATCH}, p AS (SELECT avg({_LSE.format('s')} - s[vec_id % 8 + 1]) AS pos FROM b) SELECT round(hard, 6) AS hard, round(pos, 6) AS positives, round(hard + pos, 6) AS loss FROM h, p")
def v08(t: Tables) -> DataFrame:
    # both sides of the cross join are one row
    h = _groups(t).agg(F.avg(V.nll(F.col("s"), F.lit(0))).alias("hard"))
    p = _batch(t).agg(F.avg(V.nll(F.col("s"), (F.col("vec_id") % 8).cast("int"))).alias("pos"))
    return h.crossJoin(p).select(F.round("hard", 6).alias("hard"), F.round("pos", 6).alias("positives"), F.round(F.col("hard") + F.col("pos"), 6).alias("loss"))


@query("v09_cross_device_loss", f"WITH {_B} SELECT step, vec_id % 8 // 4 AS rank, round(avg({_LSE.format('s')} - s[vec_id % 8 // 4 * 4 + vec_id % 4 + 1]), 6) AS loss FROM b GROUP BY step, vec_id % 8 // 4")
def v09(t: Tables) -> DataFrame:
    rank = F.expr("(vec_id % 8) div 4")
    return _batch(t).withColumn("rank", rank).groupBy("step", "rank").agg(F.round(F.avg(V.nll(F.col("s"), (F.col("rank") * 4 + F.col("vec_id") % 4).cast("int"))), 6).alias("loss"))


@query("v10_distillation", f"WITH {_G}, z AS (SELECT vec_id, s, list_transform(s, lambda x: x / 2) AS y FROM g) SELECT vec_id, round(-list_sum([exp(y[i] - {_LSE.format('y')}) * (s[i] - {_LSE.format('s')}) FOR i IN [1, 2, 3, 4]]), 6) AS loss FROM z")
def v10(t: Tables) -> DataFrame:
    teacher = F.transform("s", lambda x: x / 2)
    z = _groups(t).withColumns({"t": V.softmax(teacher), "z": V.logsumexp(F.col("s"))})
    return z.select("vec_id", F.round(-V.total(F.zip_with("t", F.transform("s", lambda x: x - F.col("z")), lambda p, q: p * q)), 6).alias("loss"))


@query("v12_invalid_scores", f"WITH {_E}, x AS (SELECT vec_id, CASE WHEN vec_id % 19 = 0 THEN v[1:60] WHEN vec_id % 17 = 0 THEN [CASE WHEN i = vec_id % 64 + 1 THEN 'nan'::DOUBLE ELSE v[i] END FOR i IN range(1, 65)] ELSE v END AS s FROM e) SELECT vec_id, CASE WHEN len(s) <> 64 THEN 'shape' ELSE 'nan' END AS problem FROM x WHERE len(s) <> 64 OR len(list_filter(s, lambda z: isnan(z))) > 0")
def v12(t: Tables) -> DataFrame:
    """Score rows of another length, or with a NaN at any place; some are made so here."""
    k = F.col("vec_id")
    broken = F.transform("v", lambda x, i: F.when(i == k % 64, F.lit(float("nan"))).otherwise(x))
    rows = _e(t).select("vec_id", F.when(k % 19 == 0, F.slice("v", 1, 60)).when(k % 17 == 0, broken).otherwise(F.col("v")).alias("s"))
    return V.invalid_scores(rows, "s", 64).select("vec_id", "problem")


@query("a24_global_dot_norm_cosine", f"WITH {_E} SELECT a.label AS i, b.label AS j, round(sum(list_dot_product(a.v, b.v)), 6) AS dot, round(sum(list_dot_product(a.v, b.v)) / nullif(sqrt(sum(list_dot_product(a.v, a.v))) * sqrt(sum(list_dot_product(b.v, b.v))), 0), 6) AS cosine FROM e a JOIN e b ON a.vec_id // 10 = b.vec_id // 10 AND a.label < b.label GROUP BY a.label, b.label")
def a24(t: Tables) -> DataFrame:
    e = _e(t).withColumn("k", F.expr("vec_id div 10"))
    a, b = e.select("k", F.col("label").alias("i"), F.col("v").alias("a")), e.select("k", F.col("label").alias("j"), F.col("v").alias("b"))
    x, y = F.col("a"), F.col("b")
    j = a.join(b, "k").where("i < j").groupBy("i", "j").agg(F.sum(V.dot(x, y)).alias("d"), F.sum(V.dot(x, x)).alias("p"), F.sum(V.dot(y, y)).alias("q"))
    return j.select("i", "j", F.round("d", 6).alias("dot"), F.round(F.col("d") / F.nullif(F.sqrt("p") * F.sqrt("q"), F.lit(0.0)), 6).alias("cosine"))


_C = f"{_E}, c AS (SELECT a.vec_id, a.v AS x, b.v AS y, list_dot_product(a.v, b.v) / ({_N.format('a.v')} * {_N.format('b.v')}) AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1), w AS (SELECT *, CASE WHEN abs(c) > 0.9995 THEN 0.7 ELSE sin(0.7 * acos(c)) / sin(acos(c)) END AS wx, CASE WHEN abs(c) > 0.9995 THEN 0.3 ELSE sin(0.3 * acos(c)) / sin(acos(c)) END AS wy FROM c)"


@query("v13_slerp", f"WITH {_C} SELECT vec_id, round(wx * x[1] + wy * y[1], 6) AS first, round(sqrt(list_sum([(wx * x[i] + wy * y[i]) * (wx * x[i] + wy * y[i]) FOR i IN range(1, 65)])), 6) AS norm FROM w")
def v13(t: Tables) -> DataFrame:
    a, b = _e(t), _e(t).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    j = a.join(b, "vec_id").withColumn("c", V.cosine(F.col("v"), F.col("w")))
    p, q = V.slerp_weights(F.col("c"), F.lit(0.3))
    j = j.withColumns({"p": p, "q": q}).withColumn("m", F.zip_with("v", "w", lambda x, y: F.col("p") * x + F.col("q") * y))
    return j.select("vec_id", F.round(F.get("m", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("m")), 6).alias("norm"))


@query("w14_prefix_weights", "SELECT vec_id, round(label / sum(label + 1) OVER w, 6) AS fraction, round(avg(label) OVER (PARTITION BY vec_id % 10 ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS before FROM embeddings WINDOW w AS (PARTITION BY vec_id % 10 ORDER BY vec_id ROWS UNBOUNDED PRECEDING)")
def w14(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", "label", (F.col("vec_id") % 10).alias("part"))
    r = corpus.running(e, ["part"], ["vec_id"], weight=F.col("label") + 1, labels=F.col("label"), n=F.lit(1))
    before = F.when(F.col("n") > 1, (F.col("labels") - F.col("label")) / (F.col("n") - 1))
    return r.select("vec_id", F.round(F.col("label") / F.col("weight"), 6).alias("fraction"), F.round(before, 6).alias("before"))


@query("v14_iterative_merge", f"WITH {_E} SELECT a.vec_id, round((a.v[1] + 2 * b.v[1] + 3 * c.v[1]) / 6 * 0.5, 6) AS first FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2")
def v14(t: Tables) -> DataFrame:
    """Three task vectors folded in one at a time."""
    parts = [_e(t).select((F.col("vec_id") - k).alias("vec_id"), F.col("v").alias(f"v{k}")) for k in range(3)]
    j = reduce(lambda a, b: a.join(b, "vec_id"), parts)
    m = V.merged([F.col(f"v{k}") for k in range(3)], [1.0, 2.0, 3.0], 0.5)
    return j.select("vec_id", F.round(F.get(m, F.lit(0)), 6).alias("first"))


_M = f"{_E}, m AS (SELECT a.vec_id, a.v AS x, b.v AS y, [0.25 * a.v[i] + 0.75 * b.v[i] FOR i IN range(1, 65)] AS b0 FROM e a JOIN e b ON b.vec_id = a.vec_id + 1), n AS (SELECT vec_id, x, y, list_transform(b0, lambda z: z / {_N.format('b0')}) AS u FROM m), o AS (SELECT *, list_dot_product(x, u) AS cx, list_dot_product(y, u) AS cy FROM n), k AS (SELECT *, CASE WHEN sqrt(1 - cx * cx) > 1e-8 THEN 0.25 * acos(cx) / sqrt(1 - cx * cx) ELSE 0.25 END AS kx, CASE WHEN sqrt(1 - cy * cy) > 1e-8 THEN 0.75 * acos(cy) / sqrt(1 - cy * cy) ELSE 0.75 END AS ky FROM o), tg AS (SELECT vec_id, u, [kx * (x[i] - cx * u[i]) + ky * (y[i] - cy * u[i]) FOR i IN range(1, 65)] AS g FROM k)"


@query("v15_multislerp_stats", f"WITH {_M} SELECT vec_id, round({_N.format('g')}, 5) AS step, round(cos({_N.format('g')}) * u[1] + CASE WHEN {_N.format('g')} > 1e-8 THEN sin({_N.format('g')}) / {_N.format('g')} * g[1] ELSE 0 END, 5) AS first FROM tg")
def v15(t: Tables) -> DataFrame:
    """Weighted mean on the sphere of each vector and the next."""
    a, b = _e(t), _e(t).select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    j = V.multi_slerp(a.join(b, "vec_id").select("vec_id", "v", "w"), ["v", "w"], [0.25, 0.75])
    return j.select("vec_id", F.round("step", 5).alias("step"), F.round(F.get("merged", F.lit(0)), 5).alias("first"))


_LOW = "b AS (SELECT l_returnflag AS key, l_orderkey % 50 AS i, l_linenumber AS r, sum(l_quantity)::DOUBLE AS x FROM lineitem GROUP BY ALL), a AS (SELECT l_returnflag AS key, l_linenumber AS r, l_partkey % 40 AS j, sum(l_discount)::DOUBLE AS y FROM lineitem GROUP BY ALL)"


def _low_rank(t: Tables) -> DataFrame:
    side = lambda i, j, x: t.lineitem.groupBy(F.col("l_returnflag").alias("key"), i.alias("i"), j.alias("j")).agg(F.sum(x).cast("double").alias("x"))
    r = F.col("l_linenumber").cast("long")
    return tensors.low_rank_delta(side(F.col("l_orderkey") % 50, r, "l_quantity"), side(r, F.col("l_partkey") % 40, "l_discount"), 0.5, transpose=True)


@query("v16_low_rank_product", f"WITH {_LOW} SELECT key, j AS i, i AS j, round(sum(x * y) * 0.5, 3) AS delta FROM b JOIN a USING (key, r) GROUP BY key, i, j")
def v16(t: Tables) -> DataFrame:
    """Scaled products of each key's factors, transposed, as a layer stored the other way round needs them."""
    return _low_rank(t).select("key", "i", "j", F.round("x", 3).alias("delta"))


@query("v16_shape_check", f"WITH {_LOW}, s AS (SELECT b.key, max(j) + 1 AS rows, max(i) + 1 AS cols FROM b JOIN a USING (key, r) GROUP BY b.key) SELECT key, CASE WHEN key = 'A' THEN 'no base' ELSE 'shape' END AS problem FROM s WHERE key = 'A' OR rows <> 40 OR cols <> CASE WHEN key = 'N' THEN 49 ELSE 50 END")
def v16b(t: Tables) -> DataFrame:
    """Deltas against base tensors of 40 by 50: one key has none, one another shape."""
    base = t.spark.createDataFrame([("N", 39, 48, 0.0), ("R", 39, 49, 0.0)], "key string, i long, j long, x double")
    return tensors.shape_problems(_low_rank(t), base)


@query("v18_truncated_dims", f"WITH {_E}, d AS (SELECT vec_id, v, unnest([8, 16, 32, 64]) AS dim FROM e) SELECT vec_id, dim::INT AS dim, round(v[1] / sqrt(list_dot_product(v[1:dim], v[1:dim])), 6) AS first, round(1 / (4 * sqrt(64 / dim)), 6) AS weight FROM d")
def v18(t: Tables) -> DataFrame:
    d = _e(t).withColumn("dim", F.explode(F.array(*map(F.lit, (8, 16, 32, 64)))))
    cut = V.normalise(F.slice("v", F.lit(1), F.col("dim")))
    return d.select("vec_id", "dim", F.round(F.get(cut, F.lit(0)), 6).alias("first"), F.round(1 / (4 * F.sqrt(64 / F.col("dim"))), 6).alias("weight"))


@query("v20_probe_loss", f"WITH {_B} SELECT round(avg({_LSE.format('s')} - s[vec_id % 8 + 1]), 6) AS loss FROM b")
def v20(t: Tables) -> DataFrame:
    return _batch(t).agg(F.round(F.avg(V.nll(F.col("s"), (F.col("vec_id") % 8).cast("int"))), 6).alias("loss"))


@query("f17_weight_normalisation", f"WITH {_E} SELECT vec_id, round((label + 1) / sum(label + 1) OVER (PARTITION BY vec_id % 10), 6) AS weight FROM e")
def f17(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", (F.col("label") + 1).alias("w"), (F.col("vec_id") % 10).alias("part"))
    return e.join(e.groupBy("part").agg(F.sum("w").alias("total")), "part").select("vec_id", F.round(F.col("w") / F.col("total"), 6).alias("weight"))


@query("f19_softplus", "SELECT event_id, round(ln(1 + exp(value / 100)), 6) AS softplus FROM events")
def f19(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(V.softplus(F.col("value") / 100), 6).alias("softplus"))


@query("v17_weight_search", f"WITH {_G}, a AS (SELECT unnest(range(0, 11)) / 10 AS alpha), l AS (SELECT alpha, avg({_LSE.format('m')} - m[1]) AS loss FROM (SELECT alpha, [alpha * s[i] + (1 - alpha) * s[i % 4 + 1] FOR i IN [1, 2, 3, 4]] AS m FROM g, a) GROUP BY alpha) SELECT round(alpha, 6) AS alpha, round(loss, 6) AS loss, row_number() OVER (ORDER BY round(loss, 6), alpha)::INT AS place FROM l")
def v17(t: Tables) -> DataFrame:
    """The log of a search over merge weights by probe loss; the grid stands in for gradient steps."""
    from pyspark.sql import Window

    g = _groups(t).withColumn("alpha", F.explode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i / 10)))
    turned = F.concat(F.slice("s", 2, 3), F.slice("s", 1, 1))
    m = F.zip_with("s", turned, lambda x, y: F.col("alpha") * x + (1 - F.col("alpha")) * y)
    out = g.withColumn("m", m).groupBy("alpha").agg(F.round(F.avg(V.nll(F.col("m"), F.lit(0))), 6).alias("loss"))
    return out.select(F.round("alpha", 6).alias("alpha"), "loss", F.row_number().over(Window.orderBy("loss", "alpha")).alias("place"))


@query("v19_sub_batches", f"WITH {_E} SELECT vec_id, round(v[1] + v[64], 6) AS ends, 8::INT AS n_parts FROM e")
def v19(t: Tables) -> DataFrame:
    """Vectors cut into parts of 8, handled apart and put together again in order."""
    parts = _e(t).select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, F.lit(8)))).alias("part", "x"))
    whole = parts.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("part", "x"))).alias("p"))
    v = F.flatten(F.transform("p", lambda z: z["x"]))
    return whole.select("vec_id", F.round(F.get(v, F.lit(0)) + F.get(v, F.lit(63)), 6).alias("ends"), F.size("p").alias("n_parts"))


_FOLD = "SELECT CASE WHEN abs(c) > 0.9995 THEN 1 - t ELSE sin((1 - t) * acos(c)) / sin(acos(c)) END AS p, CASE WHEN abs(c) > 0.9995 THEN t ELSE sin(t * acos(c)) / sin(acos(c)) END AS q"


@query(
    "v14_state_merge",
    f"WITH {_E}, s AS (SELECT a.vec_id // 3 AS key, unnest(range(64)) AS j, unnest(a.v) AS x, unnest(b.v) AS y, unnest(c.v) AS z FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 3 = 0), "
    f"w AS ({_FOLD} FROM (SELECT 2.0 / 3 AS t, sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)) AS c FROM s)), m AS (SELECT key, j, x, z, p * x + q * y AS m FROM s, w), "
    f"w2 AS ({_FOLD} FROM (SELECT 3.0 / 4.5 AS t, sum(m * z) / sqrt(sum(m * m)) / sqrt(sum(z * z)) AS c FROM m)) SELECT key, round(sum((j + 1) * (x + 0.5 * (p * m + q * z))), 4) AS s FROM m, w2 GROUP BY key",
)
def v14b(t: Tables) -> DataFrame:
    """Three states, each one vector of all its tensors, folded on the great circle with the mean weight of those before."""
    e = _e(t).join(_e(t).where("vec_id % 3 = 2").select(F.expr("vec_id div 3").alias("full")), F.expr("vec_id div 3") == F.col("full"))
    state = lambda k: e.where(F.col("vec_id") % 3 == k).select(F.expr("vec_id div 3").cast("string").alias("key"), F.lit(0).cast("long").alias("i"), F.posexplode("v").alias("j", "x")).withColumn("j", F.col("j").cast("long"))
    out = merging.merge_states(state(0), [state(k) for k in range(3)], [1.0, 2.0, 3.0], 0.5)
    return out.groupBy(F.col("key").cast("long").alias("key")).agg(F.round(F.sum((F.col("j") + 1) * F.col("x")), 4).alias("s"))


@query("v17_gradient_search", f"WITH {_G}, a AS (SELECT unnest(range(0, 1001)) / 1000 AS alpha), l AS (SELECT alpha, avg({_LSE.format('m')} - m[1]) AS loss FROM (SELECT alpha, [alpha * s[i] + (1 - alpha) * s[i % 4 + 1] FOR i IN [1, 2, 3, 4]] AS m FROM g, a) GROUP BY alpha) SELECT round(min(loss), 3) AS loss FROM l")
def v17b(t: Tables) -> DataFrame:
    """The least loss that gradient steps find, against a fine grid."""
    g = _groups(t).select("s", F.concat(F.slice("s", 2, 3), F.slice("s", 1, 1)).alias("turned"), F.lit(0).alias("target"))
    return merging.gradient_search(g, ["s", "turned"], "target").agg(F.round(F.min("loss"), 3).alias("loss"))
