"""Alignment with the voice: frames right on a level, in any order."""

import itertools
import random

import pytest

from reelspark.operators import timing

FRAMES = "vod_id long, clip_idx int, t double, rms double"
SEGMENTS = "vod_id long, clip_idx int, chunk_idx int, start double, end double, text string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def spread(spark):
    """Seconds of a clip are dealt over all partitions, as those of larger tables are."""
    some = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in some}
    for k, v in some.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_frames_on_the_level_do_not_depend_on_their_order(spark, spread):
    """Mean and half a deviation of these frames are the loudness of three of them but for the last bit; in order of time they come
    out above it, as in the SQL (sf0.01, VOD 56, clip 1, chunk 4). Here each VOD has them in another order."""
    loudness = [31, 34, 17, 10, 49, 14, 22, 4, 8, 29, 34, 12, 27, 11, 4, 36, 3, 10, 36, 24, 41, 50, 9, 31, 42, 31, 39, 14]
    frames = [(vod, 1, round(12.55 + i / 10, 3), k / 50.0 / 10) for vod in range(2000) for i, k in enumerate(loudness)]
    random.Random(1).shuffle(frames)
    v = spark.createDataFrame(frames, FRAMES).coalesce(1)
    s = spark.createDataFrame([(vod, 1, 4, 13.011, 14.772, "x") for vod in range(2000)], SEGMENTS)
    d = spark.createDataFrame([(vod, 1, 30.0) for vod in range(2000)], "vod_id long, clip_idx int, clip_dur double")
    assert set(rows(timing.voice_bounds(s, v, d).select("det_start", "det_end"))) == {(12.65, 15.175)}


@pytest.mark.parametrize("order", list(itertools.permutations([(0.95, 1), (0.97, 2), (1.12, 27)])))
def test_a_gap_at_the_limit_of_a_pause_does_not_depend_on_the_order(spark, order):
    """The gap is 0.4 times as loud as what lies around it but for the last bit: in order of time, no pause."""
    v = spark.createDataFrame([(1, 1, t, k / 50.0 / 10) for t, k in [*order, (1.05, 4)]], FRAMES).coalesce(1)
    s = spark.createDataFrame([(1, 1, 1, 0.0, 1.0, "a"), (1, 1, 2, 1.1, 2.0, "b")], SEGMENTS)
    assert rows(timing.close_gaps(s, v).select("chunk_idx", "start", "end")) == [(1, 0.0, 1.05), (2, 1.05, 2.0)]
