"""Audio energy: frames, score, threshold, peaks. Every step is keyed by VOD and dealt into blocks of frames, so that one
long VOD is spread over tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.folding import far_apart
from ..sources.stages import stage
from .blocks import FRAMES, SECONDS, block_of, moving_sums, neighbours, per_series, running_count


def _bucket_sums(audio_chunks: DataFrame, width: int, chunk_samples: int, keys: list[str]) -> DataFrame:
    """Sum of squares in each run of `width` samples: added up inside each chunk, then across chunk edges."""
    head = ", ".join(f"{k} {audio_chunks.schema[k].dataType.simpleString()}" for k in keys)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for values, chunk, samples in zip(b[keys].itertuples(index=False), b["chunk_idx"], b["samples"]):
                x = np.asarray(samples, np.float64) ** 2
                at = (np.arange(len(x)) + int(chunk) * chunk_samples) // width
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(x) else np.zeros(0, int)
                rows += [(*values, int(at[i]), s, int(n)) for i, s, n in zip(first, np.add.reduceat(x, first) if len(x) else [], np.diff(np.append(first, len(x))))]
            yield pd.DataFrame(rows, columns=[*keys, "bucket", "square", "n"])

    parts = audio_chunks.select(*keys, "chunk_idx", "samples").mapInPandas(sums, f"{head}, bucket long, square double, n long")
    return parts.groupBy(*keys, "bucket").agg(F.sum("square").alias("square"), F.sum("n").alias("n"))


def frame_rms(audio_chunks: DataFrame, frame: int = 2048, hop: int = 512, chunk_samples: int = 16_000, keys: tuple = ("vod_id",)) -> DataFrame:
    """Centred RMS frames with zero padding: frame t covers [hop*t - frame/2, hop*t + frame/2), t = 0 .. n // hop."""
    keys = list(keys)
    sums = _bucket_sums(audio_chunks, hop, chunk_samples, keys)
    total = sums.groupBy(*keys).agg(F.sum("n").alias("samples"))
    spine = total.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("samples") / hop))).alias("frame_idx"))
    dense = spine.join(sums.withColumnRenamed("bucket", "frame_idx"), [*keys, "frame_idx"], "left").withColumn("square", F.coalesce("square", F.lit(0.0)))
    half = frame // hop // 2
    around = moving_sums(dense.select(*keys, "frame_idx", "square"), keys, "frame_idx", {"square": "_around"}, half, half - 1)
    return around.select(*keys, "frame_idx", F.sqrt(F.col("_around") / frame).alias("rms"))


def voice_frame_rms(audio_chunks: DataFrame, win: int = 400, hop: int = 160, rate: int = 16_000, chunk_samples: int = 16_000, keys: tuple = ("vod_id", "clip_idx")) -> DataFrame:
    """Uncentred RMS over full frames only; t is the middle of the frame. win and hop are whole numbers of buckets."""
    keys = list(keys)
    unit = int(np.gcd(win, hop))
    sums = _bucket_sums(audio_chunks, unit, chunk_samples, keys)
    framed = moving_sums(sums.select(*keys, "bucket", "square", "n"), keys, "bucket", {"square": "_ahead", "n": "_n"}, 0, win // unit - 1)
    full = framed.filter((F.col("_n") == win) & (F.col("bucket") % (hop // unit) == 0))
    index = F.col("bucket") / (hop // unit)
    return full.select(*keys, index.cast("long").alias("frame_idx"), ((index * hop + win / 2) / rate).alias("t"), F.sqrt(F.col("_ahead") / win).alias("rms"))


def bandpass_sections(lo: float, hi: float, rate: float, order: int = 4) -> np.ndarray:
    """Second-order sections of a Butterworth band-pass (bilinear transform of the analog prototype)."""
    warped = 2 * rate * np.tan(np.pi * np.array([lo, hi]) / rate)
    width, centre2 = warped[1] - warped[0], warped[0] * warped[1]
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * width / 2
    poles = np.concatenate([half + np.sqrt(half**2 - centre2), half - np.sqrt(half**2 - centre2)])
    gain = (width**order / np.prod(2 * rate - poles)).real * (2 * rate) ** order
    z = (2 * rate + poles) / (2 * rate - poles)
    z = np.sort_complex(z[z.imag > 0])
    sections = np.array([[1, 0, -1, 1, -2 * p.real, abs(p) ** 2] for p in z])
    sections[0, :3] *= gain
    return sections


def filtered(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """x through all second-order sections, from a state, and the state after it: of each section the last two samples that went in and the
    last two that came out. A block's output is its own input's response, by one matrix for all blocks, plus what rings on
    from the two samples before it; only those two are carried from block to block."""
    state, after = np.zeros((len(sections), 4)) if state is None else np.reshape(state, (-1, 4)), []
    n = len(x)
    for (b0, b1, b2, _, a1, a2), (in1, in2, out1, out2) in zip(sections, state):
        ring = np.zeros((block, 3))  # responses to an impulse, to the last sample and to the one before it
        two = np.array([[0.0, 1.0, 0.0], [0.0, 0.0, 1.0]])
        for i in range(block):
            ring[i] = -a1 * two[0] - a2 * two[1] + ([1.0, 0.0, 0.0] if i == 0 else 0.0)
            two = np.stack([ring[i], two[0]])
        past = np.concatenate([[in2, in1], x])
        u = np.pad(b0 * past[2:] + b1 * past[1:-1] + b2 * past[:-2], (0, -n % block)).reshape(-1, block)
        at = np.arange(block)[:, None] - np.arange(block)
        own = u @ np.where(at >= 0, ring[np.maximum(at, 0), 0], 0.0).T
        carried, last, before = np.empty((len(u), 2)), out1, out2
        for k in range(len(u)):
            carried[k] = last, before
            last, before = (own[k, i] + ring[i, 1] * carried[k, 0] + ring[i, 2] * carried[k, 1] for i in (-1, -2))
        x = (own + carried @ ring[:, 1:].T).ravel()[:n]
        ended = np.concatenate([[out2, out1], x])
        after.append([past[-1], past[-2], ended[-1], ended[-2]])
    return x, np.array(after)


def coasting(sections: np.ndarray) -> np.ndarray:
    """The matrix by which a state goes on over one silent sample."""
    size = 4 * len(sections)
    return np.stack([filtered(sections, np.zeros(1), unit)[1].ravel() for unit in np.eye(size)], 1)


def voice_bandpass(audio_chunks: DataFrame, lo: float = 80, hi: float = 3000, rate: int = 16_000, keys: tuple = ("vod_id", "clip_idx"), run_of: int = 512) -> DataFrame:
    """Chunks of a clip with only the voice band left, by a recursive filter; an impossible band leaves the audio as it is.

    Every chunk is filtered by itself, from silence; what its state would add is linear, so states pass from chunk to chunk as products
    with powers of one small matrix. They do so in runs of chunks, and between runs in a table of one row a run; no clip's
    audio is one group. Then every chunk is filtered from its true state.
    """
    keys = list(keys)
    df = audio_chunks.select(*keys, "chunk_idx", F.coalesce("samples", F.array().cast(audio_chunks.schema["samples"].dataType)).alias("samples"))
    if not 0 < lo < hi < rate / 2:
        return df
    sections = bandpass_sections(lo, hi, rate)
    coast, most = coasting(sections), 4 * len(sections)
    samples = lambda column: [np.asarray(s, np.float64) for s in column]
    head = ", ".join(f"{k} {audio_chunks.schema[k].dataType.simpleString()}" for k in (*keys, "chunk_idx"))
    run_head = head.rpartition(", ")[0] + ", run long"

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(n=b["samples"].map(len), state=[filtered(sections, x)[1].ravel() for x in samples(b["samples"])]).drop(columns="samples")

    def passed(rows: pd.DataFrame, order: str, state: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """rows in order with the state before each, and the state after all."""
        rows, before = rows.sort_values(order), []
        for n, z in zip(rows["n"], rows["state"]):
            before.append(state)
            state = np.linalg.matrix_power(coast, int(n)) @ state + z
        return rows.assign(state=before), state

    def whole_run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[*keys, "run"]].head(1).assign(n=int(pdf["n"].sum()), state=[passed(pdf, "chunk_idx", np.zeros(most))[1]])

    def in_run(rows: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        return passed(rows, "chunk_idx", np.asarray(first["state"].iloc[0]))[0][[*keys, "chunk_idx", "state"]]

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = [filtered(sections, x, np.asarray(s))[0].astype(np.float32) for x, s in zip(samples(b["samples"]), b["state"])]
            yield b.assign(samples=y).drop(columns="state")

    states = stage(df.mapInPandas(alone, f"{head}, n long, state array<double>").withColumn("run", F.floor(F.col("chunk_idx") / run_of)), "states")
    at = [*keys, "run"]
    runs = states.groupBy(*at).applyInPandas(whole_run, f"{run_head}, n long, state array<double>")
    firsts = runs.groupBy(*keys).applyInPandas(lambda pdf: passed(pdf, "run", np.zeros(most))[0][[*at, "state"]], f"{run_head}, state array<double>")
    befores = states.groupBy(*at).cogroup(firsts.groupBy(*at)).applyInPandas(in_run, f"{head}, state array<double>")
    return df.join(befores, [*keys, "chunk_idx"]).mapInPandas(ahead, df.schema)


def energy_score(frames: DataFrame, keys: tuple = ("vod_id",), width: int = FRAMES) -> DataFrame:
    """frames + score = rms / max + 0.5 * |change| / max; the first change is 0."""
    keys = list(keys)
    change = F.coalesce(F.abs(F.col("rms") - F.col("_before.rms")), F.lit(0.0))
    # read three times from here on, sorted once
    diff = stage(neighbours(frames, keys, "frame_idx", ["rms"], width).withColumn("diff", change).drop("_before", "_after"), "diff")
    most = diff.groupBy(*keys).agg(F.max("rms").alias("max_rms"), F.max("diff").alias("max_diff"))
    return per_series(diff, keys, most, "frame_idx", width).withColumn(
        "score", F.col("rms") / (F.col("max_rms") + 1e-9) + 0.5 * (F.col("diff") / (F.col("max_diff") + 1e-9))
    ).drop("max_rms", "max_diff", "diff")


def adaptive_threshold(scored: DataFrame, keys: tuple = ("vod_id",), width: int = FRAMES) -> DataFrame:
    """scored + threshold (mean + one population standard deviation) and active."""
    keys = list(keys)
    level = scored.groupBy(*keys).agg((F.avg("score") + F.stddev_pop("score")).alias("threshold"))
    return per_series(scored, keys, level, "frame_idx", width).withColumn("active", F.col("score") >= F.col("threshold"))


def local_maxima(scored: DataFrame, width: int = FRAMES) -> DataFrame:
    """Strict local maxima at or above the threshold; a flat top counts once, at its middle; edges never count.

    Only frames where the score changes are kept: the first of a flat top is followed by its last, wherever in the series that is.
    """
    rise, fall = F.col("_before.score"), F.col("_after.score")
    seen = neighbours(scored, ["vod_id"], "frame_idx", ["score"], width).select("vod_id", "frame_idx", "score", "threshold", rise.alias("rise"), fall.alias("fall"))
    changes = seen.filter((F.col("score") >= F.col("threshold")) & ~((F.col("rise").eqNullSafe(F.col("score"))) & (F.col("fall").eqNullSafe(F.col("score")))))
    tops = neighbours(stage(changes, "changes"), ["vod_id"], "frame_idx", ["frame_idx", "fall"], width).filter("rise < score")
    flat = F.col("fall") == F.col("score")
    last, after = F.when(flat, F.col("_after.frame_idx")).otherwise(F.col("frame_idx")), F.when(flat, F.col("_after.fall")).otherwise(F.col("fall"))
    return tops.filter(after < F.col("score")).select("vod_id", F.floor((F.col("frame_idx") + last) / 2).cast("long").alias("frame_idx"), "score")


def islands(df: DataFrame, place: str, gap: float, width: float = SECONDS) -> DataFrame:
    """df + _island: rows of a VOD whose neighbours are nearer than gap share one."""
    near = neighbours(df, ["vod_id"], place, [place], width)
    marked = near.withColumn("_apart", F.coalesce(F.col(place) - F.col("_before")[place] >= gap, F.lit(True))).drop("_before", "_after")
    return running_count(marked, ["vod_id"], place, F.col("_apart"), "_island", width).drop("_apart")


def best_far_apart(df: DataFrame, place: str, gap: float, best: list, width: float = SECONDS, rounds: int = 3) -> DataFrame:
    """Best first, drop every row nearer than `gap` to one that stays. `best`: columns whose order is total within a VOD, least first.

    In a round every row that is the best within reach stays, and what is near it goes. What a row becomes in a round depends on
    rows within two gaps, so a block with as much around it plays all rounds by itself. Long ramps may leave rows undecided; those
    make short islands that never meet, and each is folded as an array.
    """
    at, most = F.col(place), math.ceil(gap)
    reach = 2 * rounds * most
    rows = df.withColumn("_rank", F.struct(*[b.alias(f"_best{i}") for i, b in enumerate(best)])).withColumn("_own", block_of(place, width))
    rows = rows.withColumn("_block", F.explode(F.sequence(block_of(at - reach, width), block_of(at + reach, width)))).withColumn("_state", F.lit("open"))
    w = W.partitionBy("vod_id", "_block").orderBy(place)
    open_, kept = F.col("_state") == "open", F.when(F.col("_state") == "kept", at)
    for _ in range(rounds):
        first = F.min(F.when(open_, F.col("_rank"))).over(w.rangeBetween(-most, most))
        rows = rows.withColumn("_state", F.when(open_ & (F.col("_rank") == first), "kept").otherwise(F.col("_state")))
        near = (at - F.max(kept).over(w.rangeBetween(-most, 0)) < gap) | (F.min(kept).over(w.rangeBetween(0, most)) - at < gap)
        rows = rows.withColumn("_state", F.when(open_ & F.coalesce(near, F.lit(False)), "gone").otherwise(F.col("_state")))
    done = stage(rows.filter("_block = _own AND _state <> 'gone'").select(*df.columns, "_rank", "_state"), "spaced")
    left = islands(done.filter("_state = 'open'").drop("_state"), place, gap, width)
    arrays = left.groupBy("vod_id", "_island").agg(F.array_sort(F.collect_list(F.struct("_rank", *df.columns))).alias("_rows"))
    folded = arrays.select(F.explode(far_apart(F.col("_rows"), place, gap)).alias("_row")).select(*[F.col("_row")[c].alias(c) for c in df.columns])
    return done.filter("_state = 'kept'").select(*df.columns).unionByName(folded)


def suppress_close_peaks(maxima: DataFrame, min_frames: int = 62) -> DataFrame:
    """Highest first (later frame first among equals), drop neighbours nearer than min_frames."""
    return best_far_apart(maxima, "frame_idx", min_frames, [-F.col("score"), -F.col("frame_idx")], FRAMES)


def top_peaks(kept: DataFrame, k: int = 50, seconds_per_frame: float = 512 / 16_000) -> DataFrame:
    w = W.partitionBy("vod_id")
    peaks = kept.select(
        "vod_id", F.round(F.col("frame_idx") * seconds_per_frame, 3).alias("timestamp"),
        F.round(F.when(F.max("score").over(w) > 0, F.col("score") / F.max("score").over(w)).otherwise(F.col("score")), 4).alias("intensity"),
    )
    best = F.row_number().over(w.orderBy(F.desc("intensity"), "timestamp"))
    return peaks.withColumn("_rank", best).filter(F.col("_rank") <= k).drop("_rank")


def detect_peaks(frames: DataFrame, min_frames: int = 62, k: int = 50, seconds_per_frame: float = 512 / 16_000) -> DataFrame:
    maxima = local_maxima(adaptive_threshold(energy_score(frames)))
    return top_peaks(suppress_close_peaks(maxima, min_frames), k, seconds_per_frame)
