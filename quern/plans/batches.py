"""Queries on batch plans, conversions and instruction templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import texts
from quern.operators import batching, checks, corpus, sampling
from quern.plans.declare import PAIRS, WIDE, Tables, md5_number, pairs, query, wide

_PLAN = "r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '42', '0', source, doc_id)), doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents), p AS (SELECT source, doc_id, r // 8 AS batch_ordinal, r % 8 AS position FROM r WHERE r // 8 < n // 8)"
_STEPS = "st AS (SELECT source, batch_ordinal, row_number() OVER (ORDER BY md5(concat_ws('|', '42', '0', source, batch_ordinal // {b})), source, batch_ordinal) - 1 AS step FROM (SELECT DISTINCT source, batch_ordinal FROM p))"


def _plan(t: Tables) -> DataFrame:
    return batching.plan(t.documents, "source", "doc_id", 8)


@query("w03_fixed_batches", f"WITH {_PLAN} SELECT * FROM p")
def w03(t: Tables) -> DataFrame:
    return _plan(t)


@query("w04_global_steps", f"WITH {_PLAN}, {_STEPS.format(b=1)} SELECT * FROM st")
def w04(t: Tables) -> DataFrame:
    return batching.steps(_plan(t), "source")


@query("w05_block_shuffle", f"WITH {_PLAN}, {_STEPS.format(b=3)} SELECT * FROM st")
def w05(t: Tables) -> DataFrame:
    return batching.steps(_plan(t), "source", block=3)


@query("w06_rank_slices", f"WITH {_PLAN}, {_STEPS.format(b=1)} SELECT step, doc_id, position, position // 4 AS rank FROM p JOIN st USING (source, batch_ordinal)")
def w06(t: Tables) -> DataFrame:
    p = _plan(t)
    return p.join(batching.steps(p, "source"), ["source", "batch_ordinal"]).select("step", "doc_id", "position", batching.rank_of(F.col("position"), 8, 2).alias("rank"))


@query("w07_instruction_rotation", f"WITH {_PLAN} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'own' ELSE ['a', 'b', 'c'][(batch_ordinal * 8 + position) % 3 + 1] END AS instruction FROM p")
def w07(t: Tables) -> DataFrame:
    own = F.when(F.col("doc_id") % 10 == 0, "own")
    return _plan(t).select("doc_id", batching.instruction(["a", "b", "c"], F.col("batch_ordinal"), F.col("position"), 8, own).alias("instruction"))


@query("w08_neighbour_negative", "SELECT doc_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS negative FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def w08(t: Tables) -> DataFrame:
    near = corpus.neighbours(t.documents, ["source"], "doc_id")
    return near.join(t.documents.select(F.col("doc_id").alias("near"), F.col("text").alias("negative")), "near").select("doc_id", "negative")


@query("w09_rank_band_negative", "WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents), b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '42', source, doc_id)), doc_id) AS k FROM s WHERE rk BETWEEN 10 AND 40) SELECT source, doc_id FROM b WHERE k <= 10")
def w09(t: Tables) -> DataFrame:
    d = t.documents.select("source", "doc_id", "n_chars")
    return sampling.rank_band(d, ["source"], [F.desc("n_chars"), F.col("doc_id")], F.col("doc_id"), 10, 40, 10).select("source", "doc_id")


@query("w15_slice_reconstruction", f"WITH {_PLAN}, {_STEPS.format(b=1)} SELECT step, string_agg(doc_id::VARCHAR, ',' ORDER BY position) AS ids, true AS same FROM p JOIN st USING (source, batch_ordinal) GROUP BY step")
def w15(t: Tables) -> DataFrame:
    p = _plan(t)
    rows = p.join(batching.steps(p, "source"), ["source", "batch_ordinal"]).withColumn("rank", batching.rank_of(F.col("position"), 8, 2))
    text = lambda c: F.transform(c, lambda x: x["doc_id"].cast("string"))
    whole = rows.groupBy("step").agg(F.array_join(text(F.sort_array(F.collect_list(F.struct("position", "doc_id")))), ",").alias("ids"))
    part = rows.groupBy("step", "rank").agg(F.array_join(text(F.sort_array(F.collect_list(F.struct("position", "doc_id")))), ",").alias("ids"))
    joined = part.groupBy("step").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ids"))), lambda x: x["ids"]), ",").alias("again"))
    return whole.join(joined, "step").select("step", "ids", (F.col("ids") == F.col("again")).alias("same"))


@query("a26_planned_stats", "SELECT source, count(*) AS n_rows, count(*) // 8 AS n_batches, count(*) // 8 * 8 AS n_instances FROM documents GROUP BY source")
def a26(t: Tables) -> DataFrame:
    return batching.planned(t.documents, "source", 8)


@query("f10_instruction_templates", f"WITH {PAIRS} SELECT query_id, 'Instruct: find' || chr(10) || 'Query: ' || query AS a, 'find' || query AS b, '<instruct>find' || chr(10) || '<query>' || query AS c FROM qp")
def f10(t: Tables) -> DataFrame:
    of = lambda style: texts.instructed(style, F.lit("find"), F.col("query"))
    return pairs(t).select("query_id", of("lines").alias("a"), of("joined").alias("b"), of("tags").alias("c"))


@query("f11_prompt_precedence", "SELECT doc_id, coalesce(CASE WHEN doc_id % 5 = 0 THEN 'name' END, CASE WHEN doc_id % 3 = 0 THEN 'type' END, CASE WHEN lang = 'en' THEN 'role' END, 'class') AS prompt FROM documents")
def f11(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select("doc_id", texts.first_prompt(F.when(d % 5 == 0, "name"), F.when(d % 3 == 0, "type"), F.when(F.col("lang") == "en", "role"), F.lit("class")).alias("prompt"))


@query("f12_block_shuffle_text", f"WITH b AS (SELECT doc_id, text, length(text) // 3 + 1 AS n FROM documents), k AS (SELECT doc_id, substr(text, (i * n + 1)::BIGINT, n::BIGINT) AS part, md5(concat_ws('|', doc_id, i)) AS h FROM b, (SELECT unnest([0, 1, 2]) AS i) WHERE length(text) > 100) SELECT doc_id, string_agg(part, ' ' ORDER BY h) AS text FROM k GROUP BY doc_id UNION ALL SELECT doc_id, text FROM documents WHERE length(text) <= 100")
def f12(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", texts.shuffled_blocks(F.col("text"), F.col("doc_id")).alias("text"))


@query("f20_truncate_and_pad", "WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS x FROM documents) SELECT doc_id, array_to_string(list_concat(x[1:least(len(x), 15)], ['</s>']), ' ') AS tokens, (ceil((least(len(x), 15) + 1) / 8) * 8)::INT AS padded FROM w")
def f20(t: Tables) -> DataFrame:
    cut = texts.truncated(texts.words(F.col("text")), 16, "</s>")
    return t.documents.select("doc_id", F.array_join(cut, " ").alias("tokens"), texts.padded(F.size(cut), 8).alias("padded"))


@query("f21_padded_cost", f"WITH {_PLAN} SELECT source, batch_ordinal, max(n_chars) * count(*) AS cost, greatest(20000 // max(n_chars), 1) AS micro, ceil(count(*) / greatest(20000 // max(n_chars), 1))::BIGINT AS forwards FROM p JOIN documents USING (source, doc_id) GROUP BY source, batch_ordinal")
def f21(t: Tables) -> DataFrame:
    p = _plan(t).join(t.documents.select("doc_id", "n_chars"), "doc_id").groupBy("source", "batch_ordinal").agg(F.max("n_chars").alias("m"), F.count(F.lit(1)).alias("n"))
    micro = texts.micro_batch(20000, F.col("m"))
    return p.select("source", "batch_ordinal", (F.col("m") * F.col("n")).alias("cost"), micro.alias("micro"), F.ceil(F.col("n") / micro).alias("forwards"))


@query("f22_trim_padding", "SELECT doc_id, array_to_string(list_transform(range(doc_id % 3, 6 - doc_id % 2), lambda x: x::VARCHAR), ',') AS kept FROM documents")
def f22(t: Tables) -> DataFrame:
    mask = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: ((i >= F.col("doc_id") % 3) & (i < 6 - F.col("doc_id") % 2)).cast("int"))
    kept = texts.unpadded(F.sequence(F.lit(0), F.lit(5)), mask)
    return t.documents.select("doc_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


@query("f07_stable_seed", f"SELECT doc_id, {md5_number("concat_ws('|', 'a', doc_id, lang)")} AS seed FROM documents")
def f07(t: Tables) -> DataFrame:
    from quern.functions.hashing import seeded

    return t.documents.select("doc_id", seeded("a", F.col("doc_id"), F.col("lang")).alias("seed"))


_CONFIGS = "cf AS (SELECT source AS dataset, (substr(source, 4)::INT % 4 - 1)::DOUBLE AS sample_factor, substr(source, 4)::INT % 3 - 1 AS sample_size, 1 + substr(source, 4)::INT % 2 AS group_size FROM documents GROUP BY source)"


@query("p22_batch_validity", f"WITH {_CONFIGS} SELECT dataset, 'the factor must be positive' AS problem FROM cf WHERE sample_factor <= 0 UNION ALL SELECT dataset, 'both a size and a factor' FROM cf WHERE sample_size >= 0 AND sample_factor <> 1 UNION ALL SELECT dataset, 'a group needs two passages' FROM cf WHERE group_size < 2")
def p22(t: Tables) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    configs = t.documents.select("source").distinct().select(F.col("source").alias("dataset"), (n % 4 - 1).cast("double").alias("sample_factor"), (n % 3 - 1).alias("sample_size"), (1 + n % 2).alias("group_size"))
    return checks.batch_problems(configs)


@query("p22_record_validity", f"WITH {WIDE}, r AS (SELECT row_index, len(list_filter([passage], lambda x: x IS NOT NULL AND x <> '')) AS p, len(list_filter([negative_1, negative_2], lambda x: x IS NOT NULL AND x <> '')) AS n FROM wide) SELECT row_index, 'no positive passages' AS problem FROM r WHERE p = 0 UNION ALL SELECT row_index, 'no negative passages' FROM r WHERE n = 0")
def p22b(t: Tables) -> DataFrame:
    rows = wide(t).select("row_index", F.filter(F.array("passage"), corpus.is_text).alias("pos"), F.filter(F.array("negative_1", "negative_2"), corpus.is_text).alias("neg"))
    return checks.record_problems(rows, "row_index", "pos", "neg")


@query("st3_ordered_delivery", f"WITH {_PLAN}, {_STEPS.format(b=1)} SELECT step, position, doc_id, row_number() OVER (ORDER BY step, position) - 1 AS delivered FROM p JOIN st USING (source, batch_ordinal)")
def st3(t: Tables) -> DataFrame:
    p = _plan(t)
    rows = p.join(batching.steps(p, "source"), ["source", "batch_ordinal"]).select("step", "position", "doc_id")
    return corpus.dense_ids(rows, ["step", "position"], "delivered")


@query("v11_group_layout", "WITH b AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch_ordinal FROM documents) SELECT source, batch_ordinal, count(*) AS n FROM b GROUP BY ALL HAVING count(*) % 4 <> 0")
def v11(t: Tables) -> DataFrame:
    """Batches, the last partial ones among them, whose passages don't make whole groups of four."""
    rows = corpus.dense_ids(t.documents.select("source", "doc_id"), ["doc_id"], "k", ["source"])
    return rows.groupBy("source", F.expr("k div 8").alias("batch_ordinal")).agg(F.count(F.lit(1)).alias("n")).where("n % 4 <> 0")
