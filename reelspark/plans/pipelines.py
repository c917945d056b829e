"""The three workloads, each over a whole catalogue at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import bounds, energy, ranking, segments, simple_windows, subtitles, timing
from ..operators.intervals import slotted
from ..params import Segmentation, Trim
from ..sources.stages import stage


def best_clips(peaks: DataFrame, transcript: DataFrame, legacy: bool = False, cfg: Segmentation = Segmentation()) -> DataFrame:
    """Catalogue to ranked, well-spaced and refined clips. The transcript is shuffled once, into slots that all joins use."""
    transcript = slotted(transcript)
    found = simple_windows.legacy_candidates(peaks, transcript) if legacy else segments.segment_clips(peaks, transcript, cfg)
    ranked = ranking.score_clips(found, transcript, peaks)
    return ranking.refine_starts(ranking.select_clips(ranked), transcript)


def best_clips_from_audio(frames: DataFrame, transcript: DataFrame, min_frames: int = 62, seconds_per_frame: float = 512 / 16_000) -> DataFrame:
    # candidates and scores read the peaks several times: the way from frames to peaks is in no plan but its own
    return best_clips(stage(energy.detect_peaks(frames, min_frames, 50, seconds_per_frame), "peaks"), transcript)


def aligned_subtitles(clips: DataFrame, transcript: DataFrame, features: DataFrame, voice_frames: DataFrame, durations: DataFrame, audio: DataFrame | None = None) -> DataFrame:
    """Clips to subtitles aligned with the voice."""
    return timing.align_subtitles(subtitles.build_subtitles(clips, transcript, features, audio), voice_frames, durations)


def real_bounds(frames: DataFrame, durations: DataFrame, transcript: DataFrame | None = None, peaks: DataFrame | None = None, p: Trim = Trim()) -> DataFrame:
    return bounds.trim_bounds(frames, durations, transcript, peaks, p)
