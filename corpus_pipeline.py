"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
what a stage returns as Parquet in the shared folder and reads it again as the
next stage's docs. All stages but the last return the columns of documents.

Stages that run Python limit the session's batches for Python workers (common.small_batches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common, packing, quality_classifier, quality_rules, secret_scan, simhash


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the quality rules reject. A null text has no words and goes; rows with a null source are one host."""
    return quality_rules.filter_stage(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier scores below its limit.

    It is fitted to the table that the pipeline starts from, in which bad documents still are; the rules have
    taken most of them out of docs. A null text is scored as an empty one. If no labeller votes bad, all stay.
    """
    common.small_batches(spark)
    return quality_classifier.filter_stage(docs, corpus=common.documents(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies. Texts without words are copies of each other."""
    common.small_batches(spark)
    return simhash.filter_stage(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All docs, with secrets in their texts masked and n_chars counted anew there; a null text stays null."""
    common.small_batches(spark)
    return secret_scan.redact_stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document; a null or empty text is one token."""
    common.small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("near_dedup", near_dedup),
    ("secrets", secrets),
    ("packing", pack),
]

#: The trained scorer, the automata and the tokenizer have no SQL form; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces and places of what the stages keep of documents; empty for an empty table."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
