"""Interval, range and nearest joins between timed tables of one VOD.

Both sides of an interval join are dealt into time buckets, so a VOD's rows meet only near each other; a pair is kept
only in the first bucket both have, so it appears once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import content_richness
from ..sources.stages import bucketed_stage

BUCKET_S = 30.0


#: A segment over more slots than this (half an hour; or its end is broken) is kept once a VOD, in a slot of its own.
MOST_SLOTS = 64
LONG = -(2**62)


def _slots(start: Column, end: Column, bucket: float) -> tuple[Column, Column]:
    return F.floor(F.least(start, end) / bucket), F.floor(F.greatest(start, end) / bucket)


def _spread(df: DataFrame, start: Column, end: Column, bucket: float) -> DataFrame:
    """Rows in every slot they touch, and in the slot where long segments are."""
    lo, hi = _slots(start, end, bucket)
    return df.withColumn("_slot_a", lo).withColumn("_bucket", F.explode(F.concat(F.sequence(lo, hi), F.array(F.lit(LONG)))))


def _dealt(transcript: DataFrame, bucket: float = BUCKET_S) -> DataFrame:
    """Segments in every slot they touch (`_bucket`; the first is `_slot_b`); long ones once."""
    lo, hi = _slots(F.col("start"), F.col("end"), bucket)
    slots = F.when(hi - lo <= MOST_SLOTS, F.sequence(lo, F.least(hi, lo + MOST_SLOTS))).otherwise(F.array(F.lit(LONG)))
    return transcript.withColumn("_slot_b", lo).withColumn("_bucket", F.explode(slots))


def slotted(transcript: DataFrame) -> DataFrame:
    """The transcript dealt into slots once, and stored in buckets of (vod_id, slot): the interval joins that follow read it where it
    lies and do not shuffle it again. Every operator takes it in place of the transcript."""
    n = int(transcript.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(transcript.select("vod_id", "seq", "start", "end", "text"))
    return bucketed_stage(dealt.repartition(n, "vod_id", "_bucket"), "transcript", n, ["vod_id", "_bucket"])


def plain(transcript: DataFrame) -> DataFrame:
    """Each segment once, whether the transcript is slotted or not."""
    if "_bucket" not in transcript.columns:
        return transcript
    return transcript.filter((F.col("_bucket") == F.col("_slot_b")) | (F.col("_bucket") == LONG)).drop("_bucket", "_slot_b")


def segments_of(transcript: DataFrame, *more: str) -> DataFrame:
    return transcript.select("vod_id", *more, F.col("seq").alias("s_seq"), F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("text").alias("s_text"))


def range_join(
    left: DataFrame, transcript: DataFrame, start: str = "start", end: str = "end",
    on: Callable[[], Column] | None = None, bucket: float = BUCKET_S,
) -> DataFrame:
    """Pairs of left rows and transcript segments (s_seq, s_start, s_end, s_text) that overlap within a VOD, or that
    meet another condition which implies touching [start, end]."""
    a = _spread(left, F.col(start), F.col(end), bucket)
    b = segments_of(transcript if "_bucket" in transcript.columns and bucket == BUCKET_S else _dealt(plain(transcript), bucket), "_bucket", "_slot_b")
    condition = on() if on else (F.col("s_start") < F.col(end)) & (F.col("s_end") > F.col(start))
    once = (F.col("_bucket") == LONG) | (F.col("_bucket") == F.greatest("_slot_a", "_slot_b"))
    pairs = a.join(b, ["vod_id", "_bucket"]).filter(condition & once)
    return pairs.select(*left.columns, "s_seq", "s_start", "s_end", "s_text")


def overlap_join(intervals: DataFrame, transcript: DataFrame) -> DataFrame:
    return range_join(intervals, transcript)


def joined_text(strip_each: bool = False) -> Column:
    from ..functions.text import strip

    part = F.struct("s_seq", strip(F.col("s_text")).alias("t") if strip_each else F.col("s_text").alias("t"))
    return F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]))


def clip_text(intervals: DataFrame, transcript: DataFrame, key: list[str], strip_each: bool = False, out: str = "body") -> DataFrame:
    """intervals + the text of their overlapping segments in transcript order ('' if none)."""
    got = overlap_join(intervals, transcript).groupBy(*key).agg(joined_text(strip_each).alias(out))
    return intervals.join(got, key, "left").withColumn(out, F.coalesce(out, F.lit("")))


def text_density(
    intervals: DataFrame, transcript: DataFrame, key: list[str], start: str = "start", end: str = "end", out: str = "density", seconds: float | None = None
) -> DataFrame:
    """intervals + characters of overlapping segments (whole, not clipped) per second. `seconds`: the length, where all have the same by
    definition; the difference of two times may be off by its last bit, and 15 characters in 30 s lie right on a limit."""
    got = range_join(intervals, transcript, start, end).groupBy(*key).agg(F.sum(F.length("s_text")).alias("_chars"))
    seconds = F.greatest(F.col(end) - F.col(start), F.lit(1e-3)) if seconds is None else F.lit(seconds)
    return intervals.join(got, key, "left").withColumn(out, F.coalesce("_chars", F.lit(0)) / seconds).drop("_chars")


def gap_has_text(intervals: DataFrame, transcript: DataFrame, key: list[str], minimum: float = 8.0) -> DataFrame:
    rich = transcript.withColumn("text", content_richness(F.col("text")).cast("string"))
    got = overlap_join(intervals.filter("end > start"), rich).groupBy(*key).agg(F.sum(F.col("s_text").cast("double")).alias("_rich"))
    return intervals.join(got, key, "left").withColumn("has_text", F.coalesce(F.col("_rich") >= minimum, F.lit(False))).drop("_rich")


def nearest(points: DataFrame, at: str, targets: DataFrame, where: str, rank: str, payload: list[str], key: list[str]) -> DataFrame:
    """points + payload of the nearest target of the same VOD; ties go to the lower rank; nulls if there is none.

    Both sides are merged in time order; each point looks back and ahead, so no pair table is built.
    """
    best = targets.groupBy("vod_id", F.col(where).alias("_t")).agg(F.min(F.struct(rank, *payload)).alias("_hit"))
    row = F.struct(F.col("_t"), F.col("_hit"))
    hits = best.select("vod_id", "_t", F.lit(0).alias("_kind"), row.alias("_row"), *[F.lit(None).cast(points.schema[k].dataType).alias(k) for k in key if k != "vod_id"])
    asks = points.select("vod_id", F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(hits.schema["_row"].dataType).alias("_row"), *[k for k in key if k != "vod_id"])
    # both frames grow row by row, one in each direction
    seen = lambda *order: F.last("_row", ignorenulls=True).over(W.partitionBy("vod_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    both = hits.unionByName(asks).withColumn("_back", seen("_t", "_kind")).withColumn("_ahead", seen(F.desc("_t"), F.desc("_kind"))).filter("_kind = 1")
    db, da = F.col("_t") - F.col("_back._t"), F.col("_ahead._t") - F.col("_t")
    back = F.col("_ahead").isNull() | (db < da) | ((db == da) & (F.col(f"_back._hit.{rank}") < F.col(f"_ahead._hit.{rank}")))
    hit = F.when(F.col("_back").isNotNull() & back, F.col("_back._hit")).otherwise(F.col("_ahead._hit"))
    found = both.select(*key, hit.alias("_hit"))
    return points.join(found, key, "left").select(*points.columns, *[F.col(f"_hit.{p}").alias(p if p not in points.columns else f"near_{p}") for p in payload])


def nearest_segment(peaks: DataFrame, transcript: DataFrame, key: list[str], at: str = "timestamp") -> DataFrame:
    mid = plain(transcript).select("vod_id", ((F.col("start") + F.col("end")) / 2).alias("mid"), "seq", F.col("text").alias("nearest_text"))
    return nearest(peaks, at, mid, "mid", "seq", ["nearest_text"], key)


def nearest_peak(clips: DataFrame, peaks: DataFrame, key: list[str], at: str = "peak_timestamp") -> DataFrame:
    """clips + near_intensity: the clip's own intensity, else the nearest peak's, else 0.5."""
    target = peaks.select("vod_id", "timestamp", F.col("timestamp").alias("rank"), F.col("intensity").alias("peak_intensity"))
    got = nearest(clips, at, target, "timestamp", "rank", ["peak_intensity"], key)
    return got.withColumn("near_intensity", F.coalesce("intensity", "peak_intensity", F.lit(0.5))).drop("peak_intensity")


def content_end(transcript: DataFrame) -> DataFrame:
    """End of the last segment by position."""
    return plain(transcript).groupBy("vod_id").agg(F.max_by("end", "seq").alias("content_end"))


def with_content_end(df: DataFrame, transcript: DataFrame) -> DataFrame:
    return df.join(content_end(transcript), "vod_id", "left").withColumn("content_end", F.coalesce("content_end", F.lit(float("inf"))))


def extend_to_segment_end(windows: DataFrame, transcript: DataFrame, key: list[str], peak: str = "peak_timestamp") -> DataFrame:
    """Move each end to the end of the last segment under way at it, plus 0.3 s, at most content_end. May shorten it."""
    if "content_end" not in windows.columns:
        windows = with_content_end(windows, transcript)
    hit = range_join(windows, transcript, peak, "end", lambda: (F.col("s_start") <= F.col("end")) & (F.col("s_end") > F.col(peak)))
    last = hit.groupBy(*key).agg(F.max("s_end").alias("_last"))
    moved = F.round(F.least(F.col("_last") + 0.3, F.col("content_end")), 3)
    return windows.join(last, key, "left").withColumn("end", F.coalesce(moved, F.col("end"))).drop("_last")


def phrase_complete(clips: DataFrame, transcript: DataFrame, key: list[str], tolerance: float = 0.5) -> DataFrame:
    """clips + phrase_complete: does any segment end less than `tolerance` from the clip's end?"""
    ends = plain(transcript).select("vod_id", F.col("end").alias("_seg_end"), F.floor(F.col("end") / tolerance).alias("_slot"))
    own = F.floor(F.col("end") / tolerance)
    asked = clips.select(*key, "end").withColumn("_slot", F.explode(F.array(own - 1, own, own + 1)))
    hits = asked.join(ends, ["vod_id", "_slot"]).filter(F.abs(F.col("_seg_end") - F.col("end")) < tolerance).select(*key).distinct()
    return clips.join(hits.withColumn("_hit", F.lit(True)), key, "left").withColumn("phrase_complete", F.coalesce("_hit", F.lit(False))).drop("_hit")


def clip_segments(clips: DataFrame, transcript: DataFrame, key: list[str]) -> DataFrame:
    """Overlapping segments in clip time, clamped to the clip."""
    return overlap_join(clips, transcript).select(
        *key, F.col("s_seq").alias("seq"), F.greatest(F.lit(0.0), F.col("s_start") - F.col("start")).alias("seg_start"),
        F.least(F.col("end") - F.col("start"), F.col("s_end") - F.col("start")).alias("seg_end"), F.col("s_text").alias("text"),
    )
