"""Score, rank, select and refine clips."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import strip, tidy
from ..sources.stages import stage
from .energy import best_far_apart
from .intervals import nearest_peak, range_join

KEY = ["vod_id", "clip_idx"]
SHORT_S, LONG_S, DENSITY_CAP = 3.0, 5.0, 15.0


def numbered(candidates: DataFrame) -> DataFrame:
    """candidates + clip_idx: their place in the list (by start). Of two peaks at one time the stronger is first, so that reruns agree."""
    louder = [F.desc("intensity")] if "intensity" in candidates.columns else []
    return candidates.withColumn("clip_idx", F.row_number().over(W.partitionBy("vod_id").orderBy("start", "end", "peak_timestamp", *louder)))


def duration_score(d: Column) -> Column:
    return (
        F.when(d < 8.0, 0.0).when(d < 20.0, (d - 8.0) / 12.0).when(d <= 45.0, 1.0).when(d <= 60.0, (60.0 - d) / 15.0).otherwise(0.0)
    )


def marks(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, "!?", ""))


def spoken(clips: DataFrame, transcript: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(key, body, hook_short, hook_long, phrase_complete) of clips near any talk: the text of the whole clip and of its first seconds, and
    whether a segment ends less than `tolerance` from its end. One join and one aggregate for all four."""
    start, end = F.col("start"), F.col("end")
    wide = clips.select(*KEY, start, end, (F.least(start, end) - tolerance).alias("_lo"), (F.greatest(end, start + LONG_S) + tolerance).alias("_hi"))
    over = lambda to: (F.col("s_start") < to) & (F.col("s_end") > start)
    parts = {"body": over(end), "hook_short": over(start + SHORT_S), "hook_long": over(start + LONG_S)}
    closed = F.abs(F.col("s_end") - end) < tolerance
    near = range_join(wide, transcript, "_lo", "_hi", lambda: parts["body"] | parts["hook_long"] | closed)
    row = F.struct("s_seq", strip(F.col("s_text")).alias("t"), *[c.alias(n) for n, c in parts.items()])
    got = near.groupBy(*KEY).agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.bool_or(closed).alias("phrase_complete"))
    text = lambda n: F.concat_ws(" ", F.transform(F.filter("_rows", lambda x: x[n]), lambda x: x["t"])).alias(n)
    return got.select(*KEY, *map(text, parts), "phrase_complete")


def score_clips(candidates: DataFrame, transcript: DataFrame, peaks: DataFrame) -> DataFrame:
    c = stage(numbered(candidates), "numbered")
    if "intensity" not in c.columns:
        c = c.withColumn("intensity", F.lit(None).cast("double"))
    c = nearest_peak(c.withColumn("peak_timestamp", F.coalesce("peak_timestamp", (F.col("start") + F.col("end")) / 2)), peaks, KEY)
    c = c.join(spoken(c, transcript), KEY, "left")
    c = c.withColumns({n: F.coalesce(n, F.lit("")) for n in ("body", "hook_short", "hook_long")}).withColumn("phrase_complete", F.coalesce("phrase_complete", F.lit(False)))
    near = peaks.select("vod_id", F.col("timestamp").alias("_t"), F.col("intensity").alias("_i"), F.floor(F.col("timestamp") / LONG_S).alias("_slot"))
    own = F.floor(F.col("start") / LONG_S)
    early = c.select(*KEY, "start").withColumn("_slot", F.explode(F.array(own, own + 1))).join(near, ["vod_id", "_slot"]).filter(
        (F.col("_t") >= F.col("start")) & (F.col("_t") < F.col("start") + LONG_S)
    ).groupBy(*KEY).agg(F.avg("_i").alias("early_energy"))
    c = stage(c.join(early, KEY, "left"), "measured")
    d = F.col("end") - F.col("start")
    short, long = F.trim("hook_short") != "", F.trim("hook_long") != ""
    c = c.select(
        "*", F.when(d > 0, F.least(F.length("body") / d, F.lit(DENSITY_CAP)) / DENSITY_CAP).otherwise(0.0).alias("text_density"),
        F.when(short, F.length("hook_short") / SHORT_S).when(long, F.length("hook_long") / LONG_S).otherwise(0.0).alias("hook_density"),
        F.when(short, marks(F.col("hook_short"))).when(long, marks(F.col("hook_long"))).otherwise(0).alias("hook_marks"),
        F.when(short | long, None).otherwise(F.coalesce("early_energy", F.lit(0.0))).alias("hook_energy"), duration_score(d).alias("duration_score"),
    )
    w = W.partitionBy("vod_id")
    most = lambda name: F.when(F.max(name).over(w) == 0, 1.0).otherwise(F.max(name).over(w).cast("double"))
    hook = F.when(F.col("hook_energy").isNotNull(), 0.5 * F.col("hook_energy")).otherwise(
        0.7 * (F.col("hook_density") / most("hook_density")) + 0.3 * (F.col("hook_marks") / most("hook_marks"))
    )
    c = c.withColumn("hook_strength", hook)
    plain = F.col("near_intensity") * 0.30 + F.col("text_density") * 0.25 + F.col("hook_strength") * 0.25 + F.col("duration_score") * 0.20
    score = tidy(F.when(F.col("phrase_complete"), F.least(plain + 0.07, F.lit(1.0))).otherwise(plain))
    features = F.struct(
        F.round("near_intensity", 4).alias("intensity"), tidy(F.col("text_density")).alias("text_density"), tidy(F.col("hook_strength")).alias("hook_strength"),
        tidy(F.col("duration_score")).alias("duration_score"), "phrase_complete",
    )
    return c.select("vod_id", "clip_idx", "start", "end", "peak_timestamp", score.alias("score"), features.alias("features")).withColumn(
        "rank", F.row_number().over(w.orderBy(F.desc("score"), "clip_idx"))
    )


def score_distribution(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("vod_id").agg(
        F.max("score").alias("max_score"), F.min("score").alias("min_score"), tidy(F.avg("score")).alias("mean_score"),
        F.round(F.max("score") - F.min("score"), 4).alias("spread"), (F.round(F.max("score") - F.min("score"), 4) < 0.1).alias("low_spread"),
    )


def eligible_clips(ranked: DataFrame, n: int = 15, min_score: float = 0.65) -> DataFrame:
    w = W.partitionBy("vod_id")
    good, all_ = F.sum(F.when(F.col("score") >= min_score, 1).otherwise(0)).over(w), F.count("*").over(w)
    few = good < F.least(F.lit(n), all_)
    return ranked.withColumn("_few", few).filter(F.when(F.col("_few"), F.col("rank") <= n).otherwise(F.col("score") >= min_score)).drop("_few")


def select_clips(ranked: DataFrame, n: int = 15, min_score: float = 0.65, gap: float = 30.0) -> DataFrame:
    """Best first, leaving out any start within `gap` of one chosen; at most n. Starts further apart are independent."""
    kept = best_far_apart(eligible_clips(ranked, n, min_score), "start", gap, [F.col("rank")])
    return kept.withColumn("_n", F.row_number().over(W.partitionBy("vod_id").orderBy("rank"))).filter(F.col("_n") <= n).drop("_n")


def refine_starts(selected: DataFrame, transcript: DataFrame) -> DataFrame:
    """Start at the next words instead of in silence, or at the start of the sentence under way."""
    key = ["vod_id", "rank"]
    c = stage(selected, "selected").withColumn("_silent_to", F.col("start") + 1.5)
    covering = range_join(c, transcript, "start", "_silent_to").groupBy(*key).agg(
        F.count("*").alias("_covering"), F.min_by(F.when(F.col("s_start") < F.col("start") - 0.3, F.col("s_start")), F.when(F.col("s_start") < F.col("start") - 0.3, F.col("s_seq"))).alias("_sentence")
    )
    upcoming = range_join(
        c.select(*key, "start", "peak_timestamp"), transcript, "start", "peak_timestamp",
        lambda: (F.col("s_start") > F.col("start")) & (F.col("s_start") < F.col("peak_timestamp")),
    ).groupBy(*key).agg(F.min("s_start").alias("_next"))
    c = c.join(covering, key, "left").join(upcoming, key, "left")
    i, start, peak = F.col("features.intensity"), F.col("start"), F.col("peak_timestamp")
    jump = F.greatest(F.lit(0.0), F.col("_next") - 0.15)
    skip = F.col("_covering").isNull() & (i < 0.80) & F.col("_next").isNotNull() & ~((i >= 0.60) & (F.col("_next") - start > 1.5)) & (peak - jump >= 8.0)
    back = F.greatest(F.lit(0.0), F.col("_sentence") - 0.15)
    align = F.col("_covering").isNotNull() & F.col("_sentence").isNotNull() & (start - back > 0) & (start - back <= 8.0)
    skip, align = F.coalesce(skip, F.lit(False)), F.coalesce(align, F.lit(False))
    new = F.when(skip, jump).when(align, back).otherwise(start)
    reason = F.when(skip, "silence_skip").when(align, "phrase_align").otherwise("no_change")
    refinement = F.struct(start.alias("original_start"), F.round(start - new, 3).alias("delta"), reason.alias("reason"))
    return c.withColumn("refinement", refinement).withColumn("start", F.round(new, 3)).drop("_silent_to", "_covering", "_sentence", "_next")


def refinement_stats(refined: DataFrame) -> DataFrame:
    kinds = ["no_change", "silence_skip", "phrase_align"]
    counts = [F.sum(F.when(F.col("refinement.reason") == k, 1).otherwise(0)).alias(k) for k in kinds]
    return refined.groupBy("vod_id").agg(*counts, F.count("*").alias("total"))


def spaced(starts: np.ndarray, gap: float) -> bool:
    """Are all starts at least `gap` apart?"""
    return bool((np.diff(np.sort(starts)) >= gap).all())
