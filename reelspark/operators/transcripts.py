"""Transcript cleaning, profile, token counts and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import content_tokens, has_transition, strip
from .intervals import clip_text, overlap_join, plain

# Texts that a recogniser gives where there is no clear voice.
JUNK = ("", "...", "…", ".", ",", "- ", "[ Música ]", "[Música]", "[Music]", "[Applause]")
LONG_SEGMENT_S = 30.0


def clean_transcript(raw: DataFrame) -> DataFrame:
    return raw.withColumn("text", strip(F.col("text"))).filter(~F.col("text").isin(*JUNK)).withColumn("start", F.round("start", 3)).withColumn("end", F.round("end", 3))


def transcript_profile(transcript: DataFrame) -> DataFrame:
    return plain(transcript).groupBy("vod_id").agg(
        F.count("*").alias("segments"),
        F.sum(F.when(F.col("end") - F.col("start") > LONG_SEGMENT_S, 1).otherwise(0)).alias("long_segments"),
        F.max_by("end", "seq").alias("coverage_end"),
    )


def vods_without_text(vods: DataFrame, transcript: DataFrame) -> DataFrame:
    """VODs whose transcription gave no segment: an error for the caller to handle."""
    return vods.join(transcript, "vod_id", "left_anti")


def clip_tokens(clips: DataFrame, transcript: DataFrame, key: list[str]) -> DataFrame:
    """(key, token, n): content words of each clip's overlapping segments."""
    hits = overlap_join(clips.select(*key, "start", "end"), transcript)
    return hits.select(*key, F.explode(content_tokens(F.col("s_text"))).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("n"))


def bow_cosine(pairs: DataFrame, a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """pairs + similarity: cosine of the word counts a and b of the same key; 0 where either is empty."""
    dot = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), [*key, "token"]).groupBy(*key).agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    norm = lambda df, out: df.groupBy(*key).agg(F.sum(F.col("n") * F.col("n")).alias(out))
    got = pairs.join(dot, key, "left").join(norm(a, "qa"), key, "left").join(norm(b, "qb"), key, "left")
    return got.withColumn("similarity", F.coalesce(F.col("dot") / (F.sqrt("qa") * F.sqrt("qb")), F.lit(0.0))).drop("dot", "qa", "qb")


def transition_flag(clips: DataFrame, transcript: DataFrame, key: list[str]) -> DataFrame:
    return clip_text(clips, transcript, key, out="_body").withColumn("has_transition", has_transition(F.col("_body"))).drop("_body")
