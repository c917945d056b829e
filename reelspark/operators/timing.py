"""Subtitle timing against the voice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import tidy
from ..sources.stages import stage
from .subtitles import KEY, halves, renumbered

FLOOR = 0.005


def _near(df: DataFrame, frames: DataFrame, lo: str, hi: str, key: list[str]) -> DataFrame:
    """Rows with the voice frames (t, rms) of their clip in [lo, hi], dealt by second. Frames without clip_idx hold for all clips of their
    VOD, and are sent once, not once a clip."""
    own = [k for k in KEY if k in frames.columns]
    a = df.filter(F.col(hi) >= F.col(lo)).withColumn("_s", F.explode(F.sequence(F.floor(lo), F.floor(hi))))
    b = frames.select(*own, "t", "rms", F.floor("t").alias("_s"))
    return a.join(b, [*own, "_s"]).filter(F.col("t").between(F.col(lo), F.col(hi))).drop("_s")


def _by_time(key: list[str]):
    """All frames of a row, in order of time: sums of doubles depend on the order, and frames may lie right on a level that comes of them."""
    return W.partitionBy(*key).orderBy("t", "rms").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def voice_bounds(segments: DataFrame, voice_frames: DataFrame, durations: DataFrame) -> DataFrame:
    """(key, det_start, det_end): first and last loud frame around each segment; no row where no voice is found."""
    key = [*KEY, "chunk_idx"]
    s = segments.join(durations, KEY).withColumn("_lo", F.greatest(F.lit(0.0), F.col("start") - 0.5)).withColumn("_hi", F.least("clip_dur", F.col("end") + 0.5))
    hit = _near(s, voice_frames, "_lo", "_hi", key)
    w = _by_time(key)
    level = F.greatest(F.lit(FLOOR), F.avg("rms").over(w) + 0.5 * F.stddev_pop("rms").over(w))
    loud = hit.withColumn("_level", level).filter(F.col("rms") >= F.col("_level"))
    first, last = F.greatest(F.min("t"), F.first("start") - 1.0), F.least(F.max("t") + 0.025, F.first("end") + 1.0)
    return loud.groupBy(*key).agg(F.greatest(F.lit(0.0), F.round(first, 3)).alias("det_start"), F.least(F.first("clip_dur"), F.round(last, 3)).alias("det_end"))


def lerp_factor(delta: Column, length: Column) -> Column:
    return F.when(length < 1.0, 0.4).when(delta < 0.2, 0.9).when(delta < 0.5, 0.7).otherwise(0.5)


def align_segments(segments: DataFrame, bounds: DataFrame, durations: DataFrame) -> DataFrame:
    """segments moved toward the voice, + debug."""
    key = [*KEY, "chunk_idx"]
    s = segments.join(bounds, key, "left").join(durations, KEY)
    length = F.col("end") - F.col("start")
    move = lambda a, b: tidy(F.col(a) + (F.col(b) - F.col(a)) * lerp_factor(F.abs(F.col(b) - F.col(a)), length), 3)
    s = s.withColumn("_a", move("start", "det_start")).withColumn("_b", move("end", "det_end"))
    short, pad = F.round(F.col("_b") - F.col("_a"), 6) < 0.6, (0.6 - (F.col("_b") - F.col("_a"))) / 2
    a = F.when(short, tidy(F.greatest(F.lit(0.0), F.col("_a") - pad), 3)).otherwise(F.col("_a"))
    b = F.when(short, tidy(F.least("clip_dur", F.col("_b") + pad), 3)).otherwise(F.col("_b"))
    found = F.col("det_start").isNotNull()
    s = s.withColumn("_x", F.when(found, a).otherwise(F.col("start"))).withColumn("_y", F.when(found, b).otherwise(F.col("end")))
    debug = F.struct(
        F.col("start").alias("original_start"), F.col("_x").alias("adjusted_start"), F.col("end").alias("original_end"), F.col("_y").alias("adjusted_end"),
        tidy(F.col("_x") - F.col("start"), 3).alias("delta_start"), tidy(F.col("_y") - F.col("end"), 3).alias("delta_end"), (~found).alias("fallback"),
    )
    return s.select(*key, F.col("_x").alias("start"), F.col("_y").alias("end"), "text", debug.alias("debug"))


def split_at_dip(segments: DataFrame, voice_frames: DataFrame, most: float = 4.0) -> DataFrame:
    """Segments over `most` seconds are cut where the middle half is quietest; the parts lose their debug."""
    key = [*KEY, "chunk_idx"]
    span = F.col("end") - F.col("start")
    long = segments.filter(span > most).select(*key, (F.col("start") + span * 0.25).alias("_lo"), (F.col("end") - span * 0.25).alias("_hi"))
    dip = _near(long, voice_frames, "_lo", "_hi", key).groupBy(*key).agg(F.round(F.min(F.struct("rms", "t"))["t"], 3).alias("_dip"))
    s = segments.join(dip, key, "left")
    cut = F.coalesce("_dip", tidy((F.col("start") + F.col("end")) / 2, 3))
    parts = F.when(span <= most, F.array(F.struct("start", "end", "text"))).otherwise(halves(cut))
    flat = s.select(*KEY, F.col("chunk_idx").alias("old"), F.when(span <= most, F.col("debug")).alias("debug"), F.posexplode(parts).alias("pos", "c"))
    return renumbered(flat.select(*KEY, "old", "pos", "debug", "c.start", "c.end", "c.text"), ["old", "pos"]).select(*key, "start", "end", "text", "debug")


def close_gaps(segments: DataFrame, voice_frames: DataFrame, least: float = 0.15) -> DataFrame:
    """Neighbours less than 0.15 s apart meet in the middle, unless the gap is a real pause."""
    key = [*KEY, "chunk_idx"]
    w = W.partitionBy(*KEY).orderBy("chunk_idx")
    gaps = segments.select(*key, F.col("end").alias("_from"), F.lead("start").over(w).alias("_to")).filter(F.col("_to") - F.col("_from") < least)
    gaps = gaps.withColumn("_lo", F.least("_from", "_to") - 0.1).withColumn("_hi", F.greatest("_from", "_to") + 0.1)
    hit = _near(gaps, voice_frames, "_lo", "_hi", key)
    inside = F.col("t").between(F.col("_from"), F.col("_to"))
    around = ((F.col("t") >= F.col("_from") - 0.1) & (F.col("t") < F.col("_from"))) | ((F.col("t") > F.col("_to")) & (F.col("t") <= F.col("_to") + 0.1))
    mean = lambda frames: F.avg(F.when(frames, F.col("rms"))).over(_by_time(key))
    e = hit.select(*key, mean(inside).alias("_gap"), mean(around).alias("_ctx")).distinct()
    pause = F.coalesce(F.when(F.col("_ctx").isNull(), F.col("_gap") < FLOOR * 1.5).otherwise(F.col("_gap") < F.col("_ctx") * 0.4), F.lit(False))
    meet = gaps.join(e, key, "left").filter(~pause).select(*key, tidy((F.col("_from") + F.col("_to")) / 2, 3).alias("_mid"))
    s = segments.join(meet, key, "left").withColumn("_before", F.lag("_mid").over(w))
    return s.withColumn("start", F.coalesce("_before", "start")).withColumn("end", F.coalesce("_mid", "end")).drop("_mid", "_before")


def alignment_report(aligned: DataFrame) -> DataFrame:
    shift = lambda f: tidy(F.avg(F.abs(F.coalesce(F.col(f"debug.{f}"), F.lit(0.0)))), 3)
    return aligned.groupBy(*KEY).agg(
        F.sum(F.when(F.col("debug.fallback"), 1).otherwise(0)).alias("align_fallbacks"), shift("delta_start").alias("avg_delta_start_s"), shift("delta_end").alias("avg_delta_end_s")
    )


def align_subtitles(segments: DataFrame, voice_frames: DataFrame, durations: DataFrame) -> DataFrame:
    # every step reads the one before more than once
    segments = stage(segments, "subtitles")
    aligned = stage(align_segments(segments, voice_bounds(segments, voice_frames, durations), durations), "aligned")
    return close_gaps(stage(split_at_dip(aligned, voice_frames), "split"), voice_frames)
