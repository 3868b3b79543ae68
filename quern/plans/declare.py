"""Registration of queries and shared inputs made from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder by name: t.documents."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return register


def md5_number(text: str) -> str:
    """The SQL of functions.hashing.seeded."""
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


#: Wide training rows made from documents, with null and empty queries, passages and negatives.
WIDE = """wide AS (SELECT doc_id AS row_index, source AS unit, lang,
 CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN '' ELSE source || ' ' || lang || ' ' || doc_id END AS query,
 CASE WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS passage,
 CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'n1 ' || lang END AS negative_1,
 CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'n2 ' || source END AS negative_2,
 CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'n10 ' || (doc_id % 11) END AS negative_10 FROM documents)"""


def wide(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    return t.documents.select(
        d.alias("row_index"),
        F.col("source").alias("unit"),
        "lang",
        F.when(d % 13 == 0, None).when(d % 29 == 0, "").otherwise(F.concat_ws(" ", "source", "lang", d.cast("string"))).alias("query"),
        F.when(d % 17 != 0, F.col("text")).alias("passage"),
        F.when(d % 3 != 0, F.concat(F.lit("n1 "), "lang")).alias("negative_1"),
        F.when(d % 7 != 0, F.concat(F.lit("n10 "), (d % 11).cast("string"))).alias("negative_10"),
        F.when(d % 5 == 0, "").otherwise(F.concat(F.lit("n2 "), "source")).alias("negative_2"),
    )


#: User turns with the next turn of their conversation: query and positive.
PAIRS = """pairs AS (SELECT conv_id, turn, text AS query, lead(text) OVER w AS passage, lead(role) OVER w AS next_role, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
qp AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, query, passage FROM pairs WHERE role = 'user' AND next_role = 'assistant')"""


def pairs(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    p = t.conversations.select("conv_id", "turn", F.col("text").alias("query"), F.lead("text").over(w).alias("passage"), F.lead("role").over(w).alias("next_role"), "role")
    return p.where("role = 'user' AND next_role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", "query", "passage")
