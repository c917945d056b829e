"""Registered queries of the training-data operators: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, lang_id, lm_scoring, mixing, ngram_join, packing, quality, ranked_search, suffix_dedup, toxicity, warc_audit, whitening
from .common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.cross_entropy_difference(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    offsets = ["start", "stop", "found_start", "found_stop"]
    return warc_audit.stored_audit(pages, warc_audit.damaged_replica(pages)).fillna(-1, offsets)  # -1: that side has none


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("row", "t1", "t2", "rank")


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontamination(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(documents(spark, sf_dir), benchmark(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": (pipeline, None),
    "op1_exact_dedup": (op1_exact_dedup, exact_dedup.ORACLE),
    "op2_quality": (op2_quality, None),
    "op3_packing": (op3_packing, None),
    "op4_lm_scoring": (op4_lm_scoring, None),
    "op5_ngram_join": (op5_ngram_join, ngram_join.ORACLE),
    "op6_warc_audit": (op6_warc_audit, warc_audit.ORACLE),
    "op7_mixing": (op7_mixing, mixing.ORACLE),
    "op8_lang_id": (op8_lang_id, None),
    "op9_suffix_dedup": (op9_suffix_dedup, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_whitening": (op11_whitening, None),
    "op12_decontamination": (op12_decontamination, decontamination.ORACLE),
    "op13_ranked_search": (op13_ranked_search, ranked_search.ORACLE),
}
