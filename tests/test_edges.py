"""Cases on an edge, each found as a difference from a query's SQL, and work that must not grow out of proportion."""

import random
import time

import pytest
from pyspark.sql import functions as F

from reelspark.functions import caption
from reelspark.operators import bounds, ranking, segments, subtitles, timing
from reelspark.params import Trim
from reelspark.plans import fixtures, pipelines
from reelspark.sources import stages

TR = "vod_id long, seq long, start double, end double, text string"
PK = "vod_id long, timestamp double, intensity double"
SEG = "vod_id long, clip_idx int, seq long, start double, end double, text string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def dense_window(spark):
    """The last two peaks of a dense window are at one time: nothing is after their middle."""
    peaks = [(100.0, 0.5), (103.0, 0.5), (130.0, 0.5), (130.0, 0.6)]
    schema = "vod_id long, idx long, start double, end double, group_peaks array<struct<timestamp:double,intensity:double>>"
    return spark.createDataFrame([(1, 0, 90.0, 155.0, peaks)], schema), spark.createDataFrame([(2, 0, 0.0, 1.0, "x")], TR)


def test_no_split_point_without_peaks_after_it(dense_window):
    assert rows(segments.split_points(*dense_window).select("pos", "at")) == [(0, 101.5), (1, 116.5)]


def test_a_window_is_cut_between_its_peaks(dense_window):
    parts = segments.soft_split(*dense_window).select("half", "start", "end", F.size("group_peaks"))
    assert rows(parts) == [(0, 90.0, 116.5, 2), (1, 116.5, 155.0, 2)]


def test_density_right_on_the_limit(spark):
    """63.3 + 30 is less than 30 s after 63.3 in the last bit (or more): 15 characters in 30 s are dense all the same."""
    start = 633.0 * 0.1
    t = spark.createDataFrame([(1, 0, 72.367, 72.7, "a" * 5), (1, 1, 85.7, 86.367, "b" * 10)], TR)
    b = spark.createDataFrame([(1, start, 569.7, "fallback", "transcript")], "vod_id long, real_start double, real_end double, start_method string, end_method string")
    assert start + 30.0 - start != 30.0
    assert bounds.trim_confidence(b, t, Trim()).first().trim_confidence == 0.38


@pytest.mark.parametrize("off", [0.0, 0.1])
def test_a_peak_with_two_characters_in_four_seconds(spark, off):
    at = next(x / 1000 for x in range(126_000, 130_000) if (x / 1000 + 2.0) - (x / 1000 - 2.0) > 4.0) if off else 100.0
    scan = spark.createDataFrame([(1, "head", i, float(i), 0.0, True) for i in range(300)], "vod_id long, side string, pos long, t double, offset double, active boolean")
    t = spark.createDataFrame([(1, 0, at - 1, at, "ab")], TR)
    p = Trim(frames_per_second=1.0)
    valid = bounds.validate_peaks(spark.createDataFrame([(1, at, 0.5)], PK), scan, t, p)
    assert rows(valid) == [(1, "head", at)] and rows(bounds.bounds_from_peaks(valid)) == [(1, at, None)]


def test_segments_without_length_go_in_silent_clips_too(spark):
    audio = spark.createDataFrame([(1, 1, 0, [0.5] * 100)], "vod_id long, clip_idx int, chunk_idx long, samples array<float>")
    segs = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, "heard"), (2, 1, 0, 0.0, 0.0, "empty"), (2, 1, 1, 0.0, 1.0, "stays")], SEG)
    assert [r.text for r in subtitles.trim_silence(segs, audio, 1000).collect()] == ["stays"]


@pytest.mark.parametrize("seed", range(3))
def test_clips_of_one_time_are_numbered_by_strength(spark, seed):
    clips = [(v, 10.0, 30.0, 20.0, i / 10) for v in range(50) for i in range(5)]
    random.Random(seed).shuffle(clips)
    got = ranking.numbered(spark.createDataFrame(clips, "vod_id long, start double, end double, peak_timestamp double, intensity double"))
    assert {(r.clip_idx, r.intensity) for r in got.collect()} == {(5 - i, i / 10) for i in range(5)}


def plain_wrap(text, most=38):
    used, one, two = 0, [], []
    for w in text.split():
        if used + len(w) <= most:
            one, used = [*one, w], used + len(w) + 1
        else:
            two.append(w)
    two = " ".join(two)
    return text if len(text) <= most else " ".join(one) + ("\n" + (two[: 2 * most - 1] + "…" if len(two) > 2 * most else two) if two else "")


def test_srt_wrap_equals_a_loop_and_takes_one_walk(spark):
    r = random.Random(5)
    texts = [" ".join("x" * r.choice([1, 3, 7, 40]) for _ in range(r.randint(0, 40))) for _ in range(200)] + ["y" * 50, " " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x.i: x.w for x in df.select("i", caption.srt_wrapped(F.col("t")).alias("w")).collect()}
    assert got == {i: plain_wrap(t) for i, t in enumerate(texts)}
    long = spark.createDataFrame([(" ".join(["palabra"] * 1500),)], "t string")
    began = time.time()
    assert long.select(caption.srt_wrapped(F.col("t")).alias("w")).first().w.startswith("palabra")
    assert time.time() - began < 20


def test_frames_for_a_whole_vod_equal_frames_for_each_clip(spark):
    r = random.Random(2)
    shared = [(v, round(0.05 + i / 10, 3), r.randint(1, 50) / 500) for v in (1, 2) for i in range(200)]
    each = [(v, c, t, x) for v, t, x in shared for c in (1, 2)]
    s = spark.createDataFrame([(v, c, k, k * 2.0, k * 2.0 + 5.5, "a b") for v in (1, 2) for c in (1, 2) for k in range(6)], "vod_id long, clip_idx int, chunk_idx int, start double, end double, text string")
    d = spark.createDataFrame([(v, c, 18.0) for v in (1, 2) for c in (1, 2)], "vod_id long, clip_idx int, clip_dur double")
    one, all_ = spark.createDataFrame(shared, "vod_id long, t double, rms double"), spark.createDataFrame(each, "vod_id long, clip_idx int, t double, rms double")
    assert rows(timing.voice_bounds(s, one, d)) == rows(timing.voice_bounds(s, all_, d)) != []
    s = s.withColumn("debug", F.lit(None).cast("string"))
    assert rows(timing.split_at_dip(s, one)) == rows(timing.split_at_dip(s, all_)) and rows(timing.close_gaps(s, one)) == rows(timing.close_gaps(s, all_))


def test_voice_frames_of_the_queries_are_not_repeated_for_each_clip(spark):
    fx = fixtures.Fixtures(spark, "/root/testdata/sf0.001")
    assert fx.voice_frames.count() == fx.table("lineitem").count()


def test_peaks_from_audio_are_worked_out_once(spark):
    frames = spark.createDataFrame([(1, i, float(i % 17 == 0) + 0.1) for i in range(200)], "vod_id long, frame_idx long, rms double")
    t = spark.createDataFrame([(1, i, i * 10.0, i * 10.0 + 8, "palabra nueva") for i in range(20)], TR)
    seen = []
    before, pipelines.best_clips = pipelines.best_clips, lambda peaks, transcript: seen.append(peaks)
    try:
        pipelines.best_clips_from_audio(frames, t, 5, 1.0)
    finally:
        pipelines.best_clips = before
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert seen[0].count() > 0 and "Window" not in plan and "Join" not in plan


def test_stage_tables_are_not_broadcast(spark):
    """A table of 2 KB on disk can be of many MB in memory; its size on disk says nothing."""
    big = stages.stage(spark.range(200_000).select((F.col("id") * 0).alias("k"), F.lit("x" * 100).alias("t")), "packed")
    few = stages.stage(spark.range(3).select(F.col("id").alias("k")), "few")
    plan = few.join(big.filter("k = 0").groupBy("k").agg(F.max("t").alias("t")), "k", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_srt_document_of_a_long_segment_takes_one_walk(spark):
    chunks = spark.createDataFrame([(1, 1, 1, 0.0, 2.5, " ".join(["palabra"] * 1500))], "vod_id long, clip_idx int, chunk_idx int, start double, end double, text string")
    began = time.time()
    srt = subtitles.srt_documents(chunks).first().srt
    assert srt.startswith("1\n00:00:00,000 --> 00:00:02,500\npalabra palabra") and time.time() - began < 20
