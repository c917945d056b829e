"""A corpus pipeline of five stages over `documents`: each is written as Parquet and read again by the next.

Every stage takes any table with the columns of `documents` and more, and an empty one, and all but the last keep its columns. Rows
that repeat a doc_id, and rows without one, are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelspark.llm import exact_dedup, lang_id, mixing, ngram_join, packing
from reelspark.llm.common import documents, stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go: null texts, texts without a letter, and texts whose two best languages are close."""
    return lang_id.recognised(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, a null one only where all are null; of rows that are the same in id and text, one. Null texts equal empty ones."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the smallest doc_id stays (null last); texts without words are linked with nothing, so all of them stay."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that each source has its share of the words; null is a source, and texts without words weigh nothing."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; a null or empty text is its end token alone."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("mixing", mixed), ("packing", packed)]

#: Language ID and tokenisation cannot be written in SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
