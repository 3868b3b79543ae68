"""The corpus pipeline: stages over documents, each written as Parquet and reread as the next one's input.

Each stage works on all that its predecessor kept. All but the last return the columns of documents; the last one adds
the token ids, so its rows are the corpus as it would be trained on, in the order of the mix.

A null text counts as empty and fails the quality rules. Null hosts, languages and sources are ones of their own; a null
doc_id keeps its row, which is like no other. Rows that repeat are judged alike, and of those that repeat a doc_id one stays
after the n-gram join. Empty tables give empty results. Further columns stay, whatever their names (none may begin with __).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import byte_bpe, host_rules, mixing, ngram_join, quality
from quern.session import as_written, delete, free, materialise, small_batches, table, temporary_tables


def prepare(spark: SparkSession) -> None:
    """What earlier stages left is given free, and Arrow batches are small."""
    free(spark)
    small_batches(spark)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; with under ten labels, or labels of one class, that is all of them."""
    prepare(spark)
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text and host pass the quality rules; null and empty texts fail them."""
    prepare(spark)
    return host_rules.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of copies and near copies; documents with a null doc_id all stay."""
    prepare(spark)
    return ngram_join.deduplicate(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order, those with a null doc_id or source as well."""
    prepare(spark)
    return mixing.take(docs, whole=True)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, in the mixed order in which they are trained on; a column named token_ids is replaced."""
    prepare(spark)
    return byte_bpe.encode_documents(as_written(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing_sources", mixing_sources),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL can't express the classifier's training, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has read and written is deleted once its result is, so one stage's is kept at a time."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with temporary_tables(spark) as keep:
            docs = keep(materialise(stage(spark, before, sf_dir), name))
        if i:
            delete(spark, before._table_path)
    return STAGES[-1][1](spark, docs, sf_dir)
