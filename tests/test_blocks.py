"""Series dealt into blocks give the rows that whole series give, whatever the block."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.operators import blocks, energy, segments

FR = "vod_id long, frame_idx long, rms double"


def series(n, seed=0, levels=6):
    """A series with many flat stretches."""
    rng = np.random.default_rng(seed)
    return np.repeat(rng.integers(0, levels, n), rng.integers(1, 9, n))[:n] / 10.0


def plain_score(x):
    diff = np.abs(np.diff(x, prepend=x[0]))
    return x / (x.max() + 1e-9) + 0.5 * (diff / (diff.max() + 1e-9))


def plain_maxima(score):
    level, out, i, n = score.mean() + score.std(), [], 0, len(score)
    while i < n:
        j = i
        while j + 1 < n and score[j + 1] == score[i]:
            j += 1
        if i and j + 1 < n and score[i - 1] < score[i] > score[j + 1] and score[i] >= level:
            out.append((i + j) // 2)
        i = j + 1
    return out


@pytest.mark.parametrize("width", [1, 3, 64, 4096])
def test_energy_of_blocks_equals_a_loop(spark, width):
    data = {1: series(300, 1), 2: series(41, 2), 3: np.array([0.5]), 4: np.full(30, 0.25)}
    frames = spark.createDataFrame([(v, i, float(x)) for v, xs in data.items() for i, x in enumerate(xs)], FR)
    scored = energy.adaptive_threshold(energy.energy_score(frames, width=width), width=width)
    got = {(r.vod_id, r.frame_idx): r.score for r in scored.collect()}
    assert len(got) == sum(map(len, data.values()))
    for v, xs in data.items():
        assert np.allclose([got[v, i] for i in range(len(xs))], plain_score(xs), atol=1e-12)
    tops = sorted((r.vod_id, r.frame_idx) for r in energy.local_maxima(scored, width).collect())
    assert tops == sorted((v, i) for v, xs in data.items() for i in plain_maxima(plain_score(xs)))


def test_flat_top_over_several_blocks(spark):
    x = [0.0, 1.0] + [5.0] * 23 + [1.0] + [5.0] * 9 + [6.0] + [0.0] * 40
    scored = spark.createDataFrame([(1, i, v, 2.0) for i, v in enumerate(x)], "vod_id long, frame_idx long, score double, threshold double")
    assert [r.frame_idx for r in energy.local_maxima(scored, 4).orderBy("frame_idx").collect()] == [13, 35]


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_moving_sums_and_neighbours(spark, width):
    rng = np.random.default_rng(width)
    at = np.sort(rng.choice(200, 60, replace=False))
    df = spark.createDataFrame([(1, int(a), float(v)) for a, v in zip(at, rng.uniform(0, 1, 60))], "k long, i long, v double")
    rows = {r.i: r.v for r in df.collect()}
    got = {r.i: r.s for r in blocks.moving_sums(df, ["k"], "i", {"v": "s"}, 7, 3, width).collect()}
    assert all(math.isclose(got[i], sum(v for j, v in rows.items() if i - 7 <= j <= i + 3)) for i in rows)
    near = {r.i: (r._before and r._before.i, r._after and r._after.i) for r in blocks.neighbours(df, ["k"], "i", ["i"], width).collect()}
    order = [None, *map(int, at), None]
    assert near == {b: (a, c) for a, b, c in zip(order, order[1:], order[2:])}
    counted = {r.i: r.n for r in blocks.running_count(df, ["k"], "i", F.col("v") > 0.5, "n", width).collect()}
    assert counted == {i: sum(rows[j] > 0.5 for j in rows if j <= i) for i in rows}


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("width", [2.0, 600.0])
def test_running_sums_at_points(spark, inclusive, width):
    rng = np.random.default_rng(4)
    events = [(k, float(t), int(v)) for k in (1, 2) for t, v in zip(rng.integers(0, 40, 50), rng.integers(0, 9, 50))]
    points = [(k, float(t)) for k in (1, 2, 3) for t in (-5, 0, 7, 7, 7.5, 39, 41, 5000)]
    got = blocks.running_at(
        spark.createDataFrame(points, "k long, p double"), ["k"], "p", spark.createDataFrame(events, "k long, t double, v long"), "t", "v", "total", inclusive, width)
    want = [(k, p, sum(v for x, t, v in events if x == k and (t < p or inclusive and t == p))) for k, p in points]
    assert sorted((r.k, r.p, r.total) for r in got.collect()) == sorted(want)


def spread(df):
    """Shares of the partitions in the rows."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def test_one_long_recording_is_spread_over_tasks(spark):
    n = 2_700_000  # a day at 31.25 frames a second
    frames = spark.range(n).select(F.lit(1).cast("long").alias("vod_id"), F.col("id").alias("frame_idx"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("rms"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        near = blocks.neighbours(frames, ["vod_id"], "frame_idx", ["rms"])
        assert spread(near) < 0.5  # four shuffle partitions
        assert spread(blocks.moving_sums(frames, ["vod_id"], "frame_idx", {"rms": "s"}, 2, 1)) < 0.5
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    rms = np.array([r.rms for r in frames.orderBy("frame_idx").limit(5000).collect()])
    score = energy.energy_score(frames).filter("frame_idx < 5000").orderBy("frame_idx").collect()
    diff = np.abs(np.diff(rms, prepend=rms[0]))
    assert np.allclose([r.score for r in score], rms / 0.999 + 0.5 * diff / 0.999, atol=1e-3)
    assert 0 < energy.detect_peaks(frames).count() <= 50


def test_sessions_of_a_long_recording(spark):
    """A day of talk: 30 000 segments and 5 000 peaks."""
    t = spark.range(30_000).select(
        F.lit(1).cast("long").alias("vod_id"), F.col("id").alias("seq"), (F.col("id") * 2.88).alias("start"), (F.col("id") * 2.88 + 1.5).alias("end"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, "palabras distintas importantes").otherwise("eh").alias("text"))
    p = spark.range(5_000).select(F.lit(1).cast("long").alias("vod_id"), (F.col("id") * 17.28).alias("timestamp"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)) / 100.0 + 0.05).alias("intensity"))
    began = time.time()
    got = segments.active_windows(p, t).collect()
    assert time.time() - began < 60
    assert sum(len(r.group_peaks) for r in got) == 5_000 and sorted(r.idx for r in got) == list(range(len(got))) and len(got) > 100
