"""Where does a stream really start and end?

Tables: frames (vod_id, frame_idx, rms), durations (vod_id, total_s), optional transcript and peaks. Head and tail are scanned
apart; `side` is 'head' or 'tail', times are absolute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import strip
from ..params import Trim
from ..sources.stages import stage
from .energy import adaptive_threshold, energy_score
from .intervals import plain, text_density

SIDE = ["vod_id", "side"]
ROW = ["vod_id"]


def scan_windows(frames: DataFrame, durations: DataFrame, p: Trim = Trim()) -> DataFrame:
    """(vod_id, side, pos, t, score, threshold, active): both windows framed, scored and thresholded on their own."""
    d = durations.withColumn("scan_s", F.least(F.lit(p.scan_s), F.col("total_s") * 0.5))
    head = d.select("vod_id", F.lit("head").alias("side"), F.lit(0.0).alias("offset"), "scan_s")
    tail = d.select("vod_id", F.lit("tail").alias("side"), F.greatest(F.lit(0.0), F.col("total_s") - F.col("scan_s")).alias("offset"), "scan_s")
    sides = head.unionByName(tail)
    t = F.col("frame_idx") / p.frames_per_second
    cut = frames.join(sides, "vod_id").filter((t >= F.col("offset")) & (t < F.col("offset") + F.col("scan_s")))
    own = F.floor(F.ceil(F.round(F.col("offset") * p.frames_per_second, 6))).cast("long")  # first frame of the window
    cut = cut.select(*SIDE, (F.col("frame_idx") - own).alias("frame_idx"), "rms", "offset")
    scored = adaptive_threshold(energy_score(cut, tuple(SIDE)), tuple(SIDE))
    return scored.select(
        *SIDE, F.col("frame_idx").alias("pos"), (F.col("frame_idx") / p.frames_per_second + F.col("offset")).alias("t"), "offset", "score", "threshold", "active"
    )


def _dense(df: DataFrame, transcript: DataFrame | None, key: list[str], start: Column, end: Column, seconds: float, least: float) -> DataFrame:
    """Rows of df whose text density over [start, end], that is `seconds`, is at least `least`; all rows if there is no transcript."""
    if transcript is None:
        return df
    t = text_density(df.withColumn("_a", start).withColumn("_b", end), transcript, key, "_a", "_b", "_d", seconds)
    return t.filter(F.col("_d") >= least).drop("_a", "_b", "_d")


def validate_peaks(peaks: DataFrame, scan: DataFrame, transcript: DataFrame | None, p: Trim = Trim()) -> DataFrame:
    """(vod_id, side, timestamp) of peaks with lasting energy, and text, around them; each peak is tried in both windows."""
    half = p.sustained_s / 2
    sides = scan.groupBy(*SIDE).agg(F.first("offset").alias("offset"), F.max("pos").alias("last"), (F.max("t") - F.first("offset")).alias("reach"))
    own = peaks.select("vod_id", "timestamp").distinct().join(sides, "vod_id")
    rel = F.col("timestamp") - F.col("offset")
    own = own.filter((rel >= 0) & (F.when(F.col("side") == "head", rel <= F.col("reach") + 1 / p.frames_per_second).otherwise(True)))
    own = own.withColumn("lo", F.greatest(F.lit(0), F.expr(f"cast(({'timestamp - offset'} - {half}) * {p.frames_per_second}D as long)")))
    own = own.withColumn("hi", F.least(F.col("last") + 1, F.expr(f"cast((timestamp - offset + {half}) * {p.frames_per_second}D as long)"))).filter("hi > lo")
    frames = scan.select(*SIDE, "pos", "active")
    spread = own.select(*SIDE, "timestamp", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("pos"))
    active = spread.join(frames, [*SIDE, "pos"]).groupBy(*SIDE, "timestamp").agg(F.avg(F.col("active").cast("int")).alias("share"))
    good = active.filter(F.col("share") >= p.active_share)
    return _dense(good, transcript, [*SIDE, "timestamp"], F.col("timestamp") - half, F.col("timestamp") + half, p.sustained_s, p.min_density).select(*SIDE, "timestamp")


def bounds_from_peaks(valid: DataFrame) -> DataFrame:
    return valid.groupBy("vod_id").agg(
        F.min(F.when(F.col("side") == "head", F.col("timestamp"))).alias("start_peaks"), F.max(F.when(F.col("side") == "tail", F.col("timestamp"))).alias("end_peaks")
    )


def scan_limits(durations: DataFrame, p: Trim = Trim()) -> DataFrame:
    scan = F.least(F.lit(p.scan_s), F.col("total_s") * 0.5)
    return durations.select("vod_id", "total_s", scan.alias("head_end"), F.greatest(F.lit(0.0), F.col("total_s") - scan).alias("tail_start"))


def bounds_from_transcript(transcript: DataFrame, durations: DataFrame, p: Trim = Trim()) -> DataFrame:
    said = plain(transcript).join(scan_limits(durations, p), "vod_id").filter(F.length(strip(F.col("text"))) > 3)
    heads = said.filter(F.col("start") <= F.col("head_end")).select("vod_id", F.col("start").alias("at")).distinct()
    heads = _dense(heads, transcript, ["vod_id", "at"], F.col("at"), F.col("at") + p.sustained_text_s, p.sustained_text_s, p.min_density)
    start = heads.groupBy("vod_id").agg(F.min("at").alias("start_transcript"))
    end = said.filter(F.col("end") >= F.col("tail_start")).groupBy("vod_id").agg(F.max("end").alias("end_transcript"))
    return start.join(end, "vod_id", "full")


def start_from_energy(scan: DataFrame, transcript: DataFrame | None, p: Trim = Trim()) -> DataFrame:
    """First head frame whose next 8 s are active enough, and have text."""
    n = int(p.activity_s * p.frames_per_second)
    w = W.partitionBy(*SIDE).orderBy("pos")
    h = scan.filter("side = 'head'").withColumn("_share", F.avg(F.col("active").cast("int")).over(w.rowsBetween(0, n - 1))).withColumn("_len", F.max("pos").over(W.partitionBy(*SIDE)) + 1)
    good = h.filter((F.col("pos") < F.col("_len") - n) & (F.col("_share") >= p.active_share)).select("vod_id", "t")
    good = _dense(good, transcript, ["vod_id", "t"], F.col("t"), F.col("t") + p.activity_s, p.activity_s, p.min_density)
    return good.groupBy("vod_id").agg(F.min("t").alias("start_energy"))


def end_from_energy(scan: DataFrame, transcript: DataFrame | None, p: Trim = Trim()) -> DataFrame:
    """Last active tail frame before 20 s with little energy and no text."""
    n = int(p.silence_s * p.frames_per_second)
    w = W.partitionBy(*SIDE).orderBy("pos")
    t = scan.filter("side = 'tail'").withColumn("_share", F.avg(F.col("active").cast("int")).over(w.rowsBetween(1, n))).withColumn("_len", F.max("pos").over(W.partitionBy(*SIDE)) + 1)
    good = t.filter(F.col("active") & (F.col("pos") > n) & (F.col("pos") <= F.col("_len") - n - 1) & (F.col("_share") < p.silence_share)).select("vod_id", "t")
    if transcript is not None:
        d = text_density(good.withColumn("_b", F.col("t") + p.silence_s), transcript, ["vod_id", "t"], "t", "_b", "_d", p.silence_s)
        good = d.filter(F.col("_d") < p.min_density).select("vod_id", "t")
    return good.groupBy("vod_id").agg(F.max("t").alias("end_energy"))


def _density_of(df: DataFrame, transcript: DataFrame | None, start: Column, end: Column, out: str, seconds: float | None = None) -> DataFrame:
    if transcript is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return text_density(df.withColumn("_a", start).withColumn("_b", end), transcript, ROW, "_a", "_b", out, seconds).drop("_a", "_b")


def trim_bounds(
    frames: DataFrame, durations: DataFrame, transcript: DataFrame | None = None, peaks: DataFrame | None = None, p: Trim = Trim()
) -> DataFrame:
    """One row per VOD: peaks before transcript before energy before the whole stream, on each side."""
    scan = stage(scan_windows(frames, durations, p), "scan")  # read by each way of finding a bound
    b = durations.join(start_from_energy(scan, transcript, p), "vod_id", "left").join(end_from_energy(scan, transcript, p), "vod_id", "left")
    none = F.lit(None).cast("double")
    if peaks is not None:
        b = b.join(bounds_from_peaks(validate_peaks(peaks, scan, transcript, p)), "vod_id", "left")
    else:
        b = b.withColumn("start_peaks", none).withColumn("end_peaks", none)
    if transcript is not None:
        b = b.join(bounds_from_transcript(transcript, durations, p), "vod_id", "left")
    else:
        b = b.withColumn("start_transcript", none).withColumn("end_transcript", none)
    for side in ("start", "end"):
        cols = [F.col(f"{side}_{k}") for k in ("peaks", "transcript", "energy")]
        b = b.withColumn(f"_{side}", F.coalesce(*cols)).withColumn(
            f"{side}_method", F.when(cols[0].isNotNull(), "peaks").when(cols[1].isNotNull(), "transcript").when(cols[2].isNotNull(), "energy").otherwise("fallback")
        )
    start = F.when(F.col("_start").isNull() | (F.col("_start") < p.safe_start_s), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.col("_start") - p.buffer_s), 3))
    b = b.withColumn("real_start", start)
    b = b if transcript is None else stage(b, "candidates")  # a density joins a table with its own rows: no chains of those
    b = _density_of(b, transcript, F.col("_end"), F.col("_end") + 15.0, "_after", 15.0)
    buffer = F.when(F.coalesce(F.col("_after"), F.lit(0.0)) >= p.min_density * 0.5, p.long_buffer_s).otherwise(p.buffer_s)
    end = F.round(F.least("total_s", F.col("_end") + buffer), 3)
    b = b.withColumn("_buffer", buffer).withColumn("real_end", end)
    if transcript is not None:
        said = plain(transcript).filter(F.length(strip(F.col("text"))) > 3).select("vod_id", F.col("end").alias("_e"))
        b = stage(b, "ends")
        last = b.select("vod_id", "real_end").join(said, "vod_id").filter(F.col("_e") <= F.col("real_end") + p.consistency_s).groupBy("vod_id").agg(F.max("_e").alias("_last"))
        b = b.join(last, "vod_id", "left")
        back = F.round(F.least("total_s", F.col("_last") + F.col("_buffer")), 3)
        b = b.withColumn("real_end", F.when(F.abs(F.col("real_end") - F.col("_last")) > p.consistency_s, back).otherwise(F.col("real_end")))
    b = b.withColumn("real_end", F.coalesce("real_end", "total_s"))
    reset = F.col("real_end") <= F.col("real_start") + p.min_kept_s
    b = b.withColumn("_reset", reset)
    b = b.select(
        "vod_id", "total_s", F.when(F.col("_reset"), 0.0).otherwise(F.col("real_start")).alias("real_start"), F.when(F.col("_reset"), F.col("total_s")).otherwise(F.col("real_end")).alias("real_end"),
        *[F.when(F.col("_reset"), "fallback").otherwise(F.col(f"{s}_method")).alias(f"{s}_method") for s in ("start", "end")],
    )
    return trim_confidence(b if transcript is None else stage(b, "bounds"), transcript, p).select(
        "vod_id", F.round("total_s", 3).alias("total_duration_s"), "real_start", "real_end", F.round(F.col("real_end") - F.col("real_start"), 3).alias("duration_trimmed"),
        F.lit(p.buffer_s).alias("buffer_s"), "start_method", "end_method", (F.col("start_method") == "fallback").alias("fallback_start"),
        (F.col("end_method") == "fallback").alias("fallback_end"), "trim_confidence",
    )


def trim_confidence(bounds: DataFrame, transcript: DataFrame | None = None, p: Trim = Trim()) -> DataFrame:
    credit = lambda c: F.when(F.col(c) == "peaks", 0.20).when(F.col(c) == "energy", 0.10).when(F.col(c) == "transcript", 0.08).otherwise(0.0)
    total = credit("start_method") + credit("end_method")
    b = bounds
    if transcript is not None:
        b = _density_of(b, transcript, F.col("real_start"), F.col("real_start") + 30.0, "_near_start", 30.0)
        b = _density_of(b, transcript, F.greatest(F.lit(0.0), F.col("real_end") - 30.0), F.col("real_end"), "_near_end")
        total = total + F.when(F.col("_near_start") >= p.min_density, 0.20).when(F.col("_near_start") >= p.min_density * 0.5, 0.10).otherwise(0.0)
        total = total + F.when(F.col("_near_end") >= p.min_density * 0.5, 0.20).when(F.col("_near_end") > 0, 0.10).otherwise(0.0)
    else:
        total = total + 0.15
    for side in ("start_method", "end_method"):
        total = total + F.when(F.col(side) != "fallback", 0.10).otherwise(0.0)
    return b.withColumn("trim_confidence", F.round(F.least(F.lit(1.0), total), 3)).drop("_near_start", "_near_end")
