"""Queries opN_<name> of the training-data operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import byte_bpe, host_rules, language, license_scan, mixing, negatives, ngram_join, packing, pivots, quality, resample, token_files, url_rules
from quern.session import free, small_batches
from quern.session import table as read_table

# The rules that the url query applies, the labels of negative mining, and the rows that language training may read.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
MOVED_LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
LEARNED = "crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    free(spark)
    small_batches(spark)
    return read_table(spark, sf_dir, name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_rules.parse_rule(r, v) for r, v in URL_RULES]
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules, ["page_id"])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with a null doc_id has no remainder: nothing is learned from it, and held_out is false."""
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.train(docs, LEARNED))
    return out.selectExpr("doc_id", f"coalesce(NOT ({LEARNED}), false) AS held_out", "lang_pred", "score", "accepted")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(*written)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"), label=MOVED_LABEL)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))[0].drop("key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_ngram_jaccard_join, op3_url_filters, op4_language_id, op5_token_files, op6_source_mixing, op7_quality_classifier, op8_host_rules, op9_byte_bpe, op10_embedding_near_dedup, op11_importance_resampling, op12_hard_negatives, op13_packing)
}

_OP3 = """
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, pre, rule, verdict) AS (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
f AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""

_OP8 = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS repeated FROM d, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(repeated, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM b GROUP BY source),
p AS (SELECT avg(failed / docs) AS m, CASE WHEN var_pop(failed / docs) > 0 THEN least(1e4, greatest(1.0, avg(failed / docs) * (1 - avg(failed / docs)) / var_pop(failed / docs) - 1)) ELSE 1e4 END AS w FROM h),
v AS (SELECT source, (failed + m * w) / (docs + w) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept, round(rate, 6) AS host_rate
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

_OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] FOR i IN range(1, len(words) - 3)] WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""

_OP10 = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) >= 0.9),
r(vec_id, reach) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, min(reach) AS component_id, min(reach) = vec_id AS kept FROM r GROUP BY vec_id
"""

# CRC-32 by its bits: the list holds each byte and then seven zeros, and a step takes in one number and one bit.
_OP11 = r"""
WITH w AS (SELECT 0 AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
r AS (SELECT side, doc_id, words[i] AS f FROM (SELECT side, doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) UNION ALL SELECT side, doc_id, words[i] || ' ' || words[i + 1] FROM (SELECT side, doc_id, words, unnest(range(1, len(words))) AS i FROM w) UNION ALL SELECT side, doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FROM (SELECT side, doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
u AS (SELECT DISTINCT f, hex(encode(f)) AS h FROM r),
c AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 4 * len(h)::BIGINT), lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(h, i // 4 + 1, 2))::BIGINT ELSE 0 END)), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 10000 AS b FROM u),
k AS (SELECT side, doc_id, b FROM r JOIN c USING (f)),
n AS (SELECT b, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM k GROUP BY b),
g AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
d AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM k JOIN g USING (b) WHERE side = 0 GROUP BY doc_id),
x AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN d USING (doc_id) WHERE side = 0),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_words >= 20)
SELECT y.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM z) // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id)
"""

_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT a, b AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.*, s.b, s.score, row_number() OVER (PARTITION BY p.a, positive_id ORDER BY score DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT a AS anchor_id, positive_id, k::INT AS rank, b AS negative_id, positive_score, score AS negative_score FROM n WHERE k <= 10
"""

ORACLES: dict[str, str] = {"op2_ngram_jaccard_join": _OP2, "op3_url_filters": _OP3, "op8_host_rules": _OP8, "op10_embedding_near_dedup": _OP10, "op11_importance_resampling": _OP11, "op12_hard_negatives": _OP12}
