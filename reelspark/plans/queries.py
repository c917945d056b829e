"""Registered queries of the library's operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import content_richness, tidy
from ..operators import bounds, energy, intervals, ranking, segments, simple_windows, subtitles, timing, transcripts
from ..params import Trim
from ..sources import files
from ..sources.stages import scratch
from . import pipelines
from .fixtures import Fixtures
from .oracle import AUDIO, HYBRID, JUNK_LIST, SPLITS, STEPS, SUBTITLES, renamed, sql, wrapped_sql

TRIM = Trim(frames_per_second=1.0)
GAP = 5  # frames between peaks in the adapters, where a frame lasts one second
WIN, CLIP = ["vod_id", "idx"], ["vod_id", "clip_idx"]
QUERIES: dict = {}


def query(select: str | None = None, raw: bool = False):
    """Register a query under its function's name, with the SELECT over the oracle's steps."""

    def add(f):
        QUERIES[f.__name__] = (lambda spark, sf_dir: f(Fixtures(spark, sf_dir)), select if raw or select is None else sql(select))
        return f

    return add


def r4(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


# ---- sources and sinks


def _as_files(df: DataFrame, columns: list[str], order: list[str], name: str) -> str:
    """Each VOD's rows as one JSON array in a file of its own folder."""
    path = scratch(df.sparkSession, name)
    rows = df.groupBy("vod_id").agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("r"))
    slim = rows.select("vod_id", F.to_json(F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in columns]))).alias("value"))
    slim.repartition("vod_id").write.partitionBy("vod_id").text(path)
    return f"{path}/*/*.txt"


@query('SELECT vod_id::VARCHAR AS vod_id, seq, start, "end", text FROM transcript')
def read_transcripts(fx):
    path = _as_files(fx.transcript, ["start", "end", "text"], ["seq"], "transcripts")
    return files.read_transcripts(fx.spark, path, r"vod_id=([^/]+)/").select("vod_id", "seq", "start", "end", "text")


@query("SELECT vod_id::VARCHAR AS vod_id, timestamp, intensity FROM peaks")
def read_peaks(fx):
    return files.read_peaks(fx.spark, _as_files(fx.peaks, ["timestamp", "intensity"], [], "peaks"), r"vod_id=([^/]+)/")


@query("SELECT vod_id, timestamp, intensity FROM peaks")
def write_stage(fx):
    path = scratch(fx.spark, "stages")
    files.write_stage(fx.peaks, "peaks", path, buckets=16)
    return fx.spark.read.parquet(f"{path}/peaks").select("vod_id", "timestamp", "intensity")


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '/videos/(\d+)', 1), ''), nullif(regexp_extract(url, '(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})', 1), ''), '2024-01-01') AS vod_id FROM pages""", raw=True)
def vod_id_from_url(fx):
    return files.vod_id_from_url(fx.table("pages").select("page_id", "url"), "url", "2024-01-01").select("page_id", "vod_id")


@query("SELECT DISTINCT user_id AS vod_id FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING sum(strlen(text)) > 1000)", raw=True)
def pending_vods(fx):
    done = fx.table("conversations").groupBy(F.col("conv_id").alias("vod_id")).agg(F.sum(F.octet_length("text")).alias("size"))
    return files.pending_vods(fx.table("events").select(F.col("user_id").alias("vod_id")).distinct(), done, min_bytes=1000)


_CLOCK = lambda t: f"printf('%02d:%02d:%02d,%03d', floor({t} / 3600)::INTEGER, floor({t} % 3600 / 60)::INTEGER, floor({t})::INTEGER % 60, floor(({t} % 1) * 1000)::INTEGER)"


@query(f"""SELECT s.vod_id, s.clip_idx, string_agg(s.chunk_idx || chr(10) || {_CLOCK('c.start')} || ' --> ' || {_CLOCK('c."end"')} || chr(10) || s.text || chr(10), chr(10) ORDER BY s.chunk_idx) AS srt
  FROM srtw s JOIN ctr c ON c.vod_id = s.vod_id AND c.clip_idx = s.clip_idx AND c.chunk_idx = s.chunk_idx GROUP BY 1, 2""")
def srt_documents(fx):
    return subtitles.srt_documents(_chunks(fx))


@query("""SELECT vod_id, clip_idx AS clip_index, start, round("end" - start, 3) AS duration, printf('clip_%02d.mp4', clip_idx) AS clip_file, printf('vertical_%03d.mp4', clip_idx) AS vertical_file,
  'ih*9/16' AS crop_w, '((iw-ih*9/16)/2)+(-40)' AS crop_x, 1080 AS out_w, 1920 AS out_h FROM clips""")
def clip_manifest(fx):
    return files.clip_manifest(fx.clips, ["start", "end", "peak_timestamp"], offset_px=-40)


@query("""SELECT d.vod_id, '2024-01-01' AS date, 'u' || d.vod_id AS vod_url, '' AS vod_title, coalesce(c.n, 0) AS total_clips, coalesce(p.n, 0) AS total_vertical, round(total_s)::BIGINT AS duration_original_sec
  FROM durations d LEFT JOIN (SELECT vod_id, count(*) AS n FROM clips GROUP BY 1) c ON c.vod_id = d.vod_id LEFT JOIN (SELECT vod_id, count(*) AS n FROM peaks GROUP BY 1) p ON p.vod_id = d.vod_id""")
def run_metadata(fx):
    vods = fx.durations.select("vod_id", F.concat(F.lit("u"), F.col("vod_id").cast("string")).alias("vod_url"), F.lit(None).cast("string").alias("vod_title"), F.col("total_s").alias("duration_s"))
    return files.run_metadata(vods, fx.clips, fx.peaks, "2024-01-01").withColumn("date", F.col("date").cast("string"))


# ---- energy and peaks


_SAMPLES = """WITH RECURSIVE c AS (SELECT label::BIGINT AS vod_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk_idx, embedding FROM embeddings),
s AS (SELECT vod_id, chunk_idx, (chunk_idx * 64 + unnest(range(64)))::BIGINT AS i, unnest(embedding)::DOUBLE AS v FROM c), n AS (SELECT vod_id, count(*) AS n FROM s GROUP BY vod_id)"""


@query(_SAMPLES + """, f AS (SELECT vod_id, unnest(range(n // 16 + 1)) AS frame_idx FROM n)
SELECT f.vod_id, f.frame_idx, round(sqrt(coalesce(sum(v * v), 0) / 64), 4) AS rms FROM f LEFT JOIN s ON s.vod_id = f.vod_id AND i >= 16 * frame_idx - 32 AND i < 16 * frame_idx + 32 GROUP BY 1, 2""", raw=True)
def frame_rms(fx):
    return energy.frame_rms(fx.audio_chunks, 64, 16, 64).select("vod_id", "frame_idx", *r4("rms"))


@query(_SAMPLES + """, k AS (SELECT vod_id, (chunk_idx % 2 + 1)::INTEGER AS clip_idx, (chunk_idx // 2) * 64 + i % 64 AS j, v FROM s), m AS (SELECT vod_id, clip_idx, count(*) AS n FROM k GROUP BY 1, 2),
f AS (SELECT vod_id, clip_idx, unnest(range((n - 20) // 8 + 1)) AS frame_idx FROM m)
SELECT f.vod_id, f.clip_idx, f.frame_idx, round((frame_idx * 8 + 10) / 640.0::DOUBLE, 4) AS t, round(sqrt(sum(v * v) / 20), 4) AS rms FROM f JOIN k ON k.vod_id = f.vod_id AND k.clip_idx = f.clip_idx AND j >= 8 * frame_idx AND j < 8 * frame_idx + 20
GROUP BY 1, 2, 3""", raw=True)
def voice_frame_rms(fx):
    return energy.voice_frame_rms(fx.clip_chunks, 20, 8, 640, 64).select("vod_id", "clip_idx", "frame_idx", *r4("t", "rms"))


def _filter_sql(lo: float, hi: float, rate: float) -> str:
    """The difference equations of the band-pass as a recursive query over samples: x goes in, y4 comes out."""
    steps, source, now = [], "x", "x"
    for m, (b0, b1, b2, _, a1, a2) in enumerate(energy.bandpass_sections(lo, hi, rate), 1):
        said = f"({b0:.17g}::DOUBLE * {now} + {b1:.17g}::DOUBLE * p_{source} + {b2:.17g}::DOUBLE * pp_{source} - {a1:.17g}::DOUBLE * p_y{m} - {a2:.17g}::DOUBLE * pp_y{m})"
        steps.append(said)
        source, now = f"y{m}", f"y{m}"
    names = ["x", "y1", "y2", "y3", "y4"]
    row = "(SELECT l.vod_id, l.clip_idx, k.j, k.v AS x, " + ", ".join(f"l.{n} AS p_{n}, l.p_{n} AS pp_{n}" for n in names) + " FROM fl l JOIN k ON k.vod_id = l.vod_id AND k.clip_idx = l.clip_idx AND k.j = l.j + 1)"
    for m, said in enumerate(steps, 1):
        row = f"(SELECT *, {said} AS y{m} FROM {row})"
    zeros = ", ".join(f"0.0::DOUBLE AS {n}, 0.0::DOUBLE AS p_{n}" for n in names)
    return f", fl AS (SELECT DISTINCT vod_id, clip_idx, -1::BIGINT AS j, {zeros} FROM k UNION ALL SELECT vod_id, clip_idx, j, {', '.join(f'{n}, p_{n}' for n in names)} FROM {row})"


_CLIPS_AUDIO = ", k AS (SELECT vod_id, (chunk_idx % 2 + 1)::INTEGER AS clip_idx, (chunk_idx // 2) * 64 + i % 64 AS j, v FROM s)"


@query(_SAMPLES + _CLIPS_AUDIO + _filter_sql(80, 300, 640) + """, m AS (SELECT vod_id, clip_idx, count(*) AS n FROM k GROUP BY 1, 2), f AS (SELECT vod_id, clip_idx, unnest(range((n - 20) // 8 + 1)) AS frame_idx FROM m)
SELECT f.vod_id, f.clip_idx, f.frame_idx, round((frame_idx * 8 + 10) / 640.0::DOUBLE, 4) AS t, round(sqrt(sum(y4::FLOAT::DOUBLE * y4::FLOAT::DOUBLE) / 20), 4) AS rms FROM f JOIN fl ON fl.vod_id = f.vod_id AND fl.clip_idx = f.clip_idx
  AND j >= 8 * frame_idx AND j < 8 * frame_idx + 20 GROUP BY 1, 2, 3""", raw=True)
def voice_bandpass(fx):
    out = energy.voice_bandpass(fx.clip_chunks, 80, 300, 640)
    return energy.voice_frame_rms(out, 20, 8, 640, 64).select("vod_id", "clip_idx", "frame_idx", *r4("t", "rms"))


@query("SELECT vod_id, frame_idx, round(score, 4) AS score FROM energy")
def energy_score(fx):
    return energy.energy_score(fx.frames).select("vod_id", "frame_idx", *r4("score"))


@query("SELECT DISTINCT vod_id, round(threshold, 4) AS threshold FROM thresh")
def adaptive_threshold(fx):
    return energy.adaptive_threshold(energy.energy_score(fx.frames)).select("vod_id", *r4("threshold")).distinct()


@query("SELECT vod_id, frame_idx, round(score, 4) AS score FROM maxima")
def local_maxima(fx):
    return energy.local_maxima(energy.adaptive_threshold(energy.energy_score(fx.frames))).select("vod_id", "frame_idx", *r4("score"))


@query("SELECT vod_id, frame_idx, round(score, 4) AS score FROM kept_max")
def suppress_close_peaks(fx):
    m = energy.local_maxima(energy.adaptive_threshold(energy.energy_score(fx.frames)))
    return energy.suppress_close_peaks(m, GAP).select("vod_id", "frame_idx", *r4("score"))


@query("SELECT vod_id, timestamp, intensity FROM top50")
def top_peaks(fx):
    return energy.detect_peaks(fx.frames, GAP, 50, 1.0)


# ---- transcript and text


@query(f"SELECT vod_id, seq, start, \"end\", text FROM transcript WHERE NOT list_contains({JUNK_LIST}, text)")
def clean_transcript(fx):
    return transcripts.clean_transcript(fx.raw_transcript)


@query("""SELECT vod_id, count(*) AS segments, count(*) FILTER ("end" - start > 30) AS long_segments, arg_max("end", seq) AS coverage_end FROM transcript GROUP BY vod_id""")
def transcript_profile(fx):
    return transcripts.transcript_profile(fx.transcript)


@query("SELECT DISTINCT user_id AS vod_id FROM events WHERE user_id NOT IN (SELECT vod_id FROM transcript)")
def vods_without_text(fx):
    return transcripts.vods_without_text(fx.table("events").select(F.col("user_id").alias("vod_id")).distinct(), fx.transcript)


@query("SELECT DISTINCT p.vod_id, coalesce(content_end, 'inf'::DOUBLE) AS content_end FROM peaks p LEFT JOIN cend c ON c.vod_id = p.vod_id")
def content_end(fx):
    return intervals.with_content_end(fx.peaks.select("vod_id").distinct(), fx.transcript)


@query("SELECT vod_id, seq, round(richness, 4) AS richness FROM rich")
def content_richness_q(fx):
    return fx.transcript.select("vod_id", "seq", F.round(content_richness(F.col("text")), 4).alias("richness"))


@query("SELECT vod_id, idx, token, n FROM tok")
def clip_tokens(fx):
    return transcripts.clip_tokens(fx.windows, fx.transcript, WIN)


@query("SELECT vod_id, idx, round(sim, 4) AS similarity FROM cosine")
def bow_cosine(fx):
    tokens = transcripts.clip_tokens(fx.windows, fx.transcript, WIN)
    pooled = tokens.select("vod_id", F.explode(F.array(F.col("idx") + 1, F.col("idx") + 2)).alias("idx"), "token", "n").groupBy(*WIN, "token").agg(F.sum("n").alias("n"))
    return transcripts.bow_cosine(fx.windows.select(*WIN), pooled, tokens, WIN).select(*WIN, *r4("similarity"))


@query("SELECT vod_id, idx, has_transition FROM trans")
def transition_flag(fx):
    return transcripts.transition_flag(fx.windows, fx.transcript, WIN).select(*WIN, "has_transition")


# ---- joins


@query("SELECT vod_id, idx, seq AS s_seq FROM win_seg")
def overlap_join(fx):
    return intervals.overlap_join(fx.windows, fx.transcript).select(*WIN, "s_seq")


@query("SELECT w.vod_id, w.idx, coalesce(body, '') AS body FROM windows w LEFT JOIN win_text t ON t.vod_id = w.vod_id AND t.idx = w.idx")
def clip_text(fx):
    return intervals.clip_text(fx.windows, fx.transcript, WIN).select(*WIN, "body")


@query("""SELECT w.vod_id, w.idx, round(coalesce(chars, 0) / greatest(w."end" - w.start, 1e-3), 4) AS density FROM windows w LEFT JOIN win_text t ON t.vod_id = w.vod_id AND t.idx = w.idx""")
def text_density(fx):
    return intervals.text_density(fx.windows, fx.transcript, WIN).select(*WIN, *r4("density"))


@query("SELECT w.vod_id, w.idx, coalesce(richness >= 8, false) AS has_text FROM windows w LEFT JOIN win_text t ON t.vod_id = w.vod_id AND t.idx = w.idx")
def gap_has_text(fx):
    return intervals.gap_has_text(fx.windows, fx.transcript, WIN).select(*WIN, "has_text")


@query("SELECT p.vod_id, p.peak_idx, nearest_text FROM rpeaks p LEFT JOIN near_seg n ON n.vod_id = p.vod_id AND n.peak_idx = p.peak_idx")
def nearest_segment(fx):
    return intervals.nearest_segment(simple_windows.ranked_peaks(fx.peaks), fx.transcript, ["vod_id", "peak_idx"]).select("vod_id", "peak_idx", "nearest_text")


@query("""SELECT w.vod_id, w.idx, coalesce(p.i, 0.5) AS near_intensity FROM windows w LEFT JOIN (SELECT w.vod_id, w.idx, arg_min(p.intensity, (abs(p.timestamp - (w.start + w."end") / 2), p.timestamp, p.intensity)) AS i
  FROM windows w JOIN peaks p ON p.vod_id = w.vod_id AND w.idx % 2 = 0 GROUP BY 1, 2) p ON p.vod_id = w.vod_id AND p.idx = w.idx WHERE w.idx % 2 = 0
  UNION ALL SELECT vod_id, idx, 0.25 FROM windows WHERE idx % 2 = 1""")
def nearest_peak(fx):
    w = fx.windows.select(*WIN, ((F.col("start") + F.col("end")) / 2).alias("peak_timestamp"), F.when(F.col("idx") % 2 == 1, 0.25).alias("intensity"))
    return intervals.nearest_peak(w, fx.peaks, WIN).select(*WIN, "near_intensity")


@query('SELECT vod_id, peak_idx, "end" FROM pw1')
def extend_to_segment_end(fx):
    pre, post = simple_windows.before_and_after()
    w = intervals.with_content_end(simple_windows.ranked_peaks(fx.peaks), fx.transcript).withColumn("end", F.least(F.col("content_end"), F.col("timestamp") + post))
    return intervals.extend_to_segment_end(w, fx.transcript, ["vod_id", "peak_idx"], "timestamp").select("vod_id", "peak_idx", "end")


@query("SELECT c.vod_id, c.clip_idx, p.vod_id IS NOT NULL AS phrase_complete FROM clips c LEFT JOIN phrase p ON p.vod_id = c.vod_id AND p.clip_idx = c.clip_idx")
def phrase_complete(fx):
    return intervals.phrase_complete(fx.clips, fx.transcript, CLIP).select(*CLIP, "phrase_complete")


@query('SELECT vod_id, clip_idx, seq, round(greatest(0, s_start - start), 4) AS seg_start, round(least("end" - start, s_end - start), 4) AS seg_end, text FROM clip_seg')
def clip_segments(fx):
    return intervals.clip_segments(fx.clips, fx.transcript, CLIP).select(*CLIP, "seq", *r4("seg_start", "seg_end"), "text")


# ---- simple candidates


@query('SELECT vod_id, peak_idx, start, "end", peak_timestamp, intensity, nearest_text FROM pw')
def peak_windows(fx):
    return simple_windows.peak_windows(fx.peaks, fx.transcript)


@query("SELECT vod_id, r.s AS start, r.e AS \"end\", r.p AS peak_timestamp, r.i AS intensity, r.t AS nearest_text FROM merged")
def merge_overlapping(fx):
    return simple_windows.merge_overlapping(simple_windows.peak_windows(fx.peaks, fx.transcript)).drop("peak_idx")


@query('SELECT vod_id, start, "end", peak_timestamp, intensity, nearest_text FROM legacy')
def legacy_candidates(fx):
    return simple_windows.legacy_candidates(fx.peaks, fx.transcript)


# ---- hybrid candidates


@query('SELECT vod_id, idx, start, "end", n_peaks, mean_intensity FROM active')
def active_windows(fx):
    w = segments.active_windows(fx.peaks, fx.transcript)
    return w.select(*WIN, "start", "end", F.size("group_peaks").alias("n_peaks"), tidy(segments.mean_intensity(F.col("group_peaks"))).alias("mean_intensity"))


@query('SELECT vod_id, idx, start, "end", semantic_score, has_transition, is_break FROM continuity')
def semantic_continuity(fx):
    return segments.semantic_continuity(fx.windows, fx.transcript).select(*WIN, "start", "end", "semantic_score", "has_transition", "is_break")


@query("""SELECT vod_id, idx, round(0.35 * least(1, greatest(0, (0.25 - sim) / 0.25)) + 0.30 * least(1, greatest(0, (0.25 - sim / 2) / 0.25)) + 0.20 * least(1, gap / 30.0)
  + 0.15 * CASE WHEN has_transition THEN least(1, greatest(0, (0.25 - sim) / 0.25)) ELSE 0 END, 3) + 0.0 AS confidence FROM cont0""")
def break_confidence(fx):
    tokens = transcripts.clip_tokens(fx.windows, fx.transcript, WIN)
    pooled = tokens.select("vod_id", F.explode(F.array(F.col("idx") + 1, F.col("idx") + 2)).alias("idx"), "token", "n").groupBy(*WIN, "token").agg(F.sum("n").alias("n"))
    w = transcripts.transition_flag(transcripts.bow_cosine(fx.windows, pooled, tokens, WIN), fx.transcript, WIN)
    sim = F.when(F.col("idx") == 0, 1.0).otherwise(F.col("similarity"))
    gap = F.col("start") - F.lag("end").over(segments.W.partitionBy("vod_id").orderBy("idx"))
    return w.withColumn("gap", gap).select(*WIN, segments.break_confidence(sim, sim / 2, F.col("gap"), F.col("has_transition")).alias("confidence"))


_CUTS = """, cuts AS (SELECT vod_id, idx, start, {k} AS step, start + 30 + {k} * 15 AS mid_at FROM (SELECT *, unnest(range(floor(("end" - start - 60) / 15)::BIGINT + 1)) AS k FROM windows WHERE "end" - start >= 60)),
tb AS (SELECT vod_id, idx, step, side, token, count(*) AS n FROM (SELECT c.vod_id, c.idx, c.step, 0 AS side, unnest(s.tokens) AS token FROM cuts c JOIN rich s ON s.vod_id = c.vod_id AND s.start < c.mid_at AND s."end" > c.mid_at - 30
  UNION ALL SELECT c.vod_id, c.idx, c.step, 1, unnest(s.tokens) FROM cuts c JOIN rich s ON s.vod_id = c.vod_id AND s.start < c.mid_at + 30 AND s."end" > c.mid_at) GROUP BY ALL),
dots AS (SELECT a.vod_id, a.idx, a.step, sum(a.n * b.n) AS d FROM tb a JOIN tb b ON a.vod_id = b.vod_id AND a.idx = b.idx AND a.step = b.step AND a.token = b.token AND a.side = 0 AND b.side = 1 GROUP BY 1, 2, 3),
nrm AS (SELECT vod_id, idx, step, side, sqrt(sum(n * n)) AS q FROM tb GROUP BY ALL),
scored AS (SELECT c.vod_id, c.idx, c.mid_at, coalesce(d / (a.q * b.q), 0) AS sim FROM cuts c LEFT JOIN dots d ON d.vod_id = c.vod_id AND d.idx = c.idx AND d.step = c.step
  LEFT JOIN nrm a ON a.vod_id = c.vod_id AND a.idx = c.idx AND a.step = c.step AND a.side = 0 LEFT JOIN nrm b ON b.vod_id = c.vod_id AND b.idx = c.idx AND b.step = c.step AND b.side = 1
  WHERE c.vod_id IN (SELECT vod_id FROM transcript))
""".replace("{k}", "k")


@query(sql("").rstrip() + _CUTS + "SELECT vod_id, idx, round(arg_min(mid_at, (sim, mid_at)), 3) AS break_at FROM scored WHERE sim < 1 GROUP BY 1, 2 HAVING min(sim) < 0.25", raw=True)
def internal_breaks(fx):
    return segments.internal_breaks(fx.windows, fx.transcript, WIN)


@query(sql('SELECT vod_id, idx, pos::INTEGER AS pos, round(mid_at::DECIMAL(24, 10), 4)::DOUBLE AS "at", split_score FROM pts', SPLITS), raw=True)
def split_points(fx):
    p = segments.split_points(fx.windows, fx.transcript)
    return p.select(*WIN, "pos", tidy(F.col("at")).alias("at"), "split_score")


@query(sql('SELECT vod_id, old_idx, half, start, "end", len(gp)::INTEGER AS n_peaks FROM parts', SPLITS), raw=True)
def soft_split(fx):
    s = segments.soft_split(fx.windows, fx.transcript)
    return s.select("vod_id", "old_idx", "half", "start", "end", F.size("group_peaks").alias("n_peaks"))


@query('SELECT vod_id, arg_max(start, k) AS start, arg_max("end", k) AS "end", arg_max(n, k)::INTEGER AS n_peaks FROM mergewf GROUP BY vod_id, idx')
def merge_windows(fx):
    c = segments.semantic_continuity(fx.windows, fx.transcript)
    m = segments.merge_windows(fx.windows, c.filter("is_break"))
    return m.select("vod_id", "start", "end", F.size("group_peaks").alias("n_peaks"))


@query('SELECT vod_id, idx, start, "end", peak_timestamp, intensity, energy_score, nearest_text, confidence_score FROM metrics')
def clip_metrics(fx):
    m = segments.clip_metrics(fx.windows, fx.transcript)
    return m.select(*WIN, "start", "end", "peak_timestamp", "intensity", "energy_score", "nearest_text", "confidence_score")


@query("SELECT vod_id, moment_tier, count(*) AS n FROM tiers GROUP BY 1, 2")
def moment_tier(fx):
    return segments.tier_counts(segments.clip_metrics(fx.windows, fx.transcript))


@query("""SELECT vod_id, idx, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY vod_id ORDER BY start, idx) AS place FROM (
  SELECT *, bool_or(k) OVER (PARTITION BY vod_id, start, "end") AS keep FROM (SELECT *, confidence_score >= 0.15 OR row_number() OVER (PARTITION BY vod_id ORDER BY energy_score DESC, idx) <= 5 AS k FROM metrics))
  WHERE keep AND "end" - start BETWEEN 8 AND 120) WHERE place <= 25""")
def quality_or_viral(fx):
    return segments.quality_or_viral(segments.clip_metrics(fx.windows, fx.transcript)).select(*WIN, "start", "end")


@query(sql('SELECT vod_id, start, "end", peak_timestamp, intensity, nearest_text, energy_score, semantic_score, confidence_score, moment_tier, topic_continuity, has_transition FROM h_found', HYBRID), raw=True)
def segment_clips(fx):
    return segments.segment_clips(fx.peaks, fx.transcript)


# ---- ranking


def _ranked(fx):
    return ranking.score_clips(fx.clips, fx.transcript, fx.peaks)


def _flat(df, *more):
    f = [F.col(f"features.{n}").alias(n) for n in ("intensity", "text_density", "hook_strength", "duration_score", "phrase_complete")]
    return df.select("vod_id", "clip_idx", "start", "end", "peak_timestamp", *more, *f)


@query('SELECT vod_id, clip_idx, start, "end", peak_timestamp, score, intensity, text_density, hook_strength, duration_score, phrase_complete FROM ranked')
def score_clips(fx):
    return _flat(_ranked(fx), "score")


@query("SELECT vod_id, max(score) AS max_score, min(score) AS min_score, round(avg(score)::DECIMAL(24, 10), 4)::DOUBLE AS mean_score, round(max(score) - min(score), 4) AS spread, round(max(score) - min(score), 4) < 0.1 AS low_spread FROM ranked GROUP BY vod_id")
def score_distribution(fx):
    return ranking.score_distribution(_ranked(fx))


@query('SELECT vod_id, clip_idx, start, "end", score FROM selected')
def select_clips(fx):
    return ranking.select_clips(_ranked(fx)).select("vod_id", "clip_idx", "start", "end", "score")


@query('SELECT vod_id, clip_idx, new_start AS start, start AS original_start, "end", delta, reason FROM refined')
def refine_starts(fx):
    r = ranking.refine_starts(ranking.select_clips(_ranked(fx)), fx.transcript)
    return r.select("vod_id", "clip_idx", "start", F.col("refinement.original_start").alias("original_start"), "end", F.col("refinement.delta").alias("delta"), F.col("refinement.reason").alias("reason"))


@query("SELECT vod_id, count(*) FILTER (reason = 'no_change') AS no_change, count(*) FILTER (reason = 'silence_skip') AS silence_skip, count(*) FILTER (reason = 'phrase_align') AS phrase_align, count(*) AS total FROM refined GROUP BY vod_id")
def refinement_stats(fx):
    return ranking.refinement_stats(ranking.refine_starts(ranking.select_clips(_ranked(fx)), fx.transcript))


@query(sql('SELECT vod_id, new_start AS start, "end", peak_timestamp, score, reason FROM b_refined', HYBRID), raw=True)
def best_clips(fx):
    b = pipelines.best_clips(fx.peaks, fx.transcript)
    return b.select("vod_id", "start", "end", "peak_timestamp", "score", F.col("refinement.reason").alias("reason"))


@query(sql('SELECT vod_id, new_start AS start, "end", peak_timestamp, score, reason FROM b_refined', {**HYBRID, "peaks": "SELECT * FROM top50"}, AUDIO), raw=True)
def best_clips_from_audio(fx):
    b = pipelines.best_clips_from_audio(fx.frames, fx.transcript, GAP, 1.0)
    return b.select("vod_id", "start", "end", "peak_timestamp", "score", F.col("refinement.reason").alias("reason"))


# ---- subtitles


def _segments(fx):
    return subtitles.clip_transcript(fx.clips, fx.transcript)


def _chunks(fx):
    """Segments as chunks, uncut: for the operators that take any chunk table."""
    return subtitles.renumbered(_segments(fx), ["seq"]).drop("seq")


@query('SELECT vod_id, clip_idx, seq, start, "end", text FROM ctr')
def clip_transcript(fx):
    return _segments(fx)


@query(sql("").rstrip() + ", " + _SAMPLES.removeprefix("WITH RECURSIVE ") + ", k AS (SELECT vod_id, (chunk_idx % 2 + 1)::INTEGER AS clip_idx, (chunk_idx // 2) * 64 + i % 64 AS j, (v / 8)::FLOAT::DOUBLE AS v FROM s)" + """,
heard AS (SELECT vod_id, clip_idx, count(*) AS total FROM k GROUP BY 1, 2),
sp AS (SELECT c.*, total, least(floor(start * 640)::BIGINT, total) AS a, least(floor("end" * 640)::BIGINT, total) - least(floor(start * 640)::BIGINT, total) - 25 AS room FROM ctr c JOIN heard h ON h.vod_id = c.vod_id AND h.clip_idx = c.clip_idx),
wn AS (SELECT vod_id, clip_idx, seq, 0 AS side, n, a + 12 * n AS lo FROM (SELECT *, unnest(range(ceil(least(room, 224) / 12.0)::BIGINT)) AS n FROM sp WHERE room >= 0)
  UNION ALL SELECT vod_id, clip_idx, seq, 1, n, a + room - 12 * n FROM (SELECT *, unnest(range(ceil(least(room, 224) / 12.0)::BIGINT)) AS n FROM sp WHERE room >= 0)),
ld AS (SELECT vod_id, clip_idx, seq, side, n FROM (SELECT w.*, (SELECT sum(k.v * k.v) FROM k WHERE k.vod_id = w.vod_id AND k.clip_idx = w.clip_idx AND k.j >= w.lo AND k.j < w.lo + 25) AS sq FROM wn w) WHERE sqrt(sq / 25) >= 0.015),
ed AS (SELECT vod_id, clip_idx, seq, min(n) FILTER (side = 0) AS h, min(n) FILTER (side = 1) AS t FROM ld GROUP BY 1, 2, 3),
mv AS (SELECT s.vod_id, s.clip_idx, s.seq, coalesce(s.start + h * 12 / 640.0::DOUBLE, s.start) AS x, coalesce(s.start + (room - t * 12 + 25) / 640.0::DOUBLE, s."end") AS y FROM sp s JOIN ed e ON e.vod_id = s.vod_id AND e.clip_idx = s.clip_idx AND e.seq = s.seq)
SELECT * FROM (SELECT c.vod_id, c.clip_idx, c.seq, CASE WHEN y - x >= 0.1 THEN round(x::DECIMAL(24, 10), 3)::DOUBLE ELSE c.start END AS start, CASE WHEN y - x >= 0.1 THEN round(y::DECIMAL(24, 10), 3)::DOUBLE ELSE c."end" END AS "end", c.text
  FROM ctr c LEFT JOIN mv m ON m.vod_id = c.vod_id AND m.clip_idx = c.clip_idx AND m.seq = c.seq) WHERE "end" > start""", raw=True)
def trim_silence(fx):
    audio = fx.clip_chunks.withColumn("samples", F.transform("samples", lambda x: (x / 8).cast("float")))
    return subtitles.trim_silence(_segments(fx), audio, rate=640)


@query('SELECT vod_id, clip_idx, chunk_idx, start, "end", text FROM chs')
def chunk_segments(fx):
    return subtitles.chunk_segments(_segments(fx))


@query('SELECT vod_id, clip_idx, chunk_idx, start, "end", text FROM hls')
def highlight_keywords(fx):
    return subtitles.highlight_keywords(subtitles.chunk_segments(_segments(fx)), fx.features)


@query(sql("SELECT vod_id, clip_idx, chunk_idx, text FROM laid", {"laid": wrapped_sql("ctw")}), raw=True)
def wrap_lines(fx):
    return subtitles.wrap_lines(_chunks(fx)).select(*CLIP, "chunk_idx", "text")


@query("SELECT vod_id, clip_idx, chunk_idx::INTEGER AS chunk_idx, text FROM srtw")
def srt_wrap(fx):
    return subtitles.srt_wrap(_chunks(fx)).select(*CLIP, "chunk_idx", "text")


@query("""SELECT vod_id, clip_idx, chunk_idx, 0 AS half, start, "end", array_to_string(w, ' ') AS text FROM ctw WHERE "end" - start <= 4 UNION ALL
  SELECT vod_id, clip_idx, chunk_idx, 0, start, round(((start + "end") / 2)::DECIMAL(24, 10), 3)::DOUBLE, array_to_string(w[:greatest(1, len(w) // 2)], ' ') FROM ctw WHERE "end" - start > 4 UNION ALL
  SELECT vod_id, clip_idx, chunk_idx, 1, round(((start + "end") / 2)::DECIMAL(24, 10), 3)::DOUBLE, "end", array_to_string(w[greatest(1, len(w) // 2) + 1:], ' ') FROM ctw WHERE "end" - start > 4""".replace(
    "SELECT vod_id, clip_idx, chunk_idx, 0 AS half, start", "SELECT vod_id, clip_idx, start").replace("SELECT vod_id, clip_idx, chunk_idx, 0, start", "SELECT vod_id, clip_idx, start").replace(
    "SELECT vod_id, clip_idx, chunk_idx, 1, round", "SELECT vod_id, clip_idx, round"))
def cap_duration(fx):
    c = subtitles.cap_duration(_chunks(fx))
    return c.select(*CLIP, "start", "end", F.concat_ws(" ", subtitles.text_words(F.col("text"))).alias("text"))


@query("""SELECT vod_id, clip_idx, chunk_idx::INTEGER AS chunk_idx, start, CASE WHEN nxt < e THEN greatest(round(start + 0.1, 3), round(nxt - 0.05, 3)) ELSE e END AS "end", text
  FROM (SELECT *, lead(start) OVER (PARTITION BY vod_id, clip_idx ORDER BY chunk_idx) AS nxt FROM (SELECT vod_id, clip_idx, chunk_idx, start, "end" + 0.75 AS e, text FROM ctr))""")
def fix_overlaps(fx):
    return subtitles.fix_overlaps(_chunks(fx).withColumn("end", F.col("end") + 0.75)).select(*CLIP, "chunk_idx", "start", "end", "text")


_IS_UP = lambda x: f"(length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) > 1 AND regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g') = upper(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')))"


@query(f"""SELECT vod_id, clip_idx, chunk_idx::INTEGER AS chunk_idx, CASE WHEN 2 * len(list_filter(w, lambda x: {_IS_UP('x')})) > len(w) THEN array_to_string(list_transform(tok, lambda x, i: CASE WHEN {_IS_UP('x')}
  AND len(list_filter(tok[:i - 1], lambda y: {_IS_UP('y')})) >= 2 THEN CASE WHEN i = 1 THEN upper(lower(x)[1]) || lower(x)[2:] ELSE lower(x) END ELSE x END), ' ') ELSE text END AS text
  FROM (SELECT *, string_split(text, ' ') AS tok, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM (SELECT vod_id, clip_idx, chunk_idx, CASE WHEN chunk_idx % 2 = 0 THEN upper(replace(text, 'ß', 'ss')) ELSE text END AS text FROM ctr))""")
def calm_caps(fx):
    return subtitles.calm_caps(_chunks(fx).withColumn("text", F.when(F.col("chunk_idx") % 2 == 0, F.upper(F.regexp_replace("text", "ß", "ss"))).otherwise(F.col("text")))).select(*CLIP, "chunk_idx", "text")


_UPPER = """SELECT vod_id, clip_idx, count(*) AS segment_count, sum(len(w))::BIGINT AS words, sum(len(list_filter(list_transform(w, lambda x: regexp_replace(x, '[^\\p{L}\\p{N}_]', '', 'g')), lambda x: length(x) > 1 AND x = upper(x))))::BIGINT AS highlight_count
  FROM (SELECT vod_id, clip_idx, list_transform(w, lambda x, i: CASE WHEN i % 4 = 0 THEN upper(replace(x, 'ß', 'ss')) ELSE x END) AS w FROM ctw) GROUP BY 1, 2"""


def _shouted(fx):
    w = F.transform(subtitles.text_words(F.col("text")), lambda x, i: F.when((i + 1) % 4 == 0, F.upper(F.regexp_replace(x, "ß", "ss"))).otherwise(x))
    return _chunks(fx).withColumn("text", F.concat_ws(" ", w))


@query(f"SELECT *, CASE WHEN words > 0 THEN round(highlight_count / words, 3) ELSE 0 END AS highlight_density FROM ({_UPPER})")
def highlight_stats(fx):
    return subtitles.highlight_stats(_shouted(fx))


@query(f"""SELECT c.vod_id, c.clip_idx, false AS subtitles_edited, true AS highlight_enabled, coalesce(highlight_count, 0) AS highlight_count, coalesce(CASE WHEN words > 0 THEN round(highlight_count / words, 3) ELSE 0 END, 0) AS highlight_density,
  0 AS edited_segments, c.start AS clip_start, c."end" AS clip_end, coalesce(segment_count, 0) AS segment_count, -0.2::DOUBLE AS subtitle_offset FROM clips c LEFT JOIN ({_UPPER}) h ON h.vod_id = c.vod_id AND h.clip_idx = c.clip_idx""")
def subtitle_meta(fx):
    return subtitles.subtitle_meta(fx.clips, _shouted(fx), fx.features)


@query("SELECT vod_id, clip_idx, chunk_idx::INTEGER AS chunk_idx, CASE WHEN clip_idx % 2 = 0 THEN 'edited ' || text ELSE text END AS text FROM ctr")
def protect_edited(fx):
    meta = fx.clips.select(*CLIP, (F.col("clip_idx") % 2 == 0).alias("subtitles_edited"))
    chunks = _chunks(fx)
    edited = chunks.withColumn("text", F.concat(F.lit("edited "), "text"))
    return subtitles.protect_edited(chunks, meta, edited).select(*CLIP, "chunk_idx", "text")


@query(f"""SELECT c.vod_id, c.clip_idx, c.clip_idx % 2 = 0 AND h.vod_id IS NOT NULL AS subtitles_edited, coalesce(highlight_count, 0) AS highlight_count, coalesce(CASE WHEN words > 0 THEN round(highlight_count / words, 3) ELSE 0 END, 0) AS highlight_density,
  CASE WHEN c.clip_idx % 2 = 0 THEN coalesce(segment_count, 0) ELSE 0 END AS edited_segments FROM clips c LEFT JOIN ({_UPPER}) h ON h.vod_id = c.vod_id AND h.clip_idx = c.clip_idx""")
def edited_meta(fx):
    meta = subtitles.subtitle_meta(fx.clips, _shouted(fx), fx.features)
    out = subtitles.edited_meta(meta, _shouted(fx).filter("clip_idx % 2 = 0"))
    return out.select(*CLIP, "subtitles_edited", "highlight_count", "highlight_density", "edited_segments")


@query(f"""SELECT vod_id, count(*) AS total, sum(e::INTEGER)::BIGINT AS edited, round(avg(n), 1) AS avg_highlights, round(avg(d), 3) AS avg_density, bool_and(e) AS ready FROM (
  SELECT c.vod_id, c.clip_idx % 2 = 0 AND h.vod_id IS NOT NULL AS e, coalesce(highlight_count, 0) AS n, coalesce(CASE WHEN words > 0 THEN round(highlight_count / words, 3) ELSE 0 END, 0) AS d
  FROM clips c LEFT JOIN ({_UPPER}) h ON h.vod_id = c.vod_id AND h.clip_idx = c.clip_idx) GROUP BY vod_id""")
def review_summary(fx):
    meta = subtitles.subtitle_meta(fx.clips, _shouted(fx), fx.features)
    return subtitles.review_summary(subtitles.edited_meta(meta, _shouted(fx).filter("clip_idx % 2 = 0")))


@query(sql('SELECT vod_id, clip_idx, chunk_idx, start, "end", text FROM st_calm', SUBTITLES), raw=True)
def build_subtitles(fx):
    return subtitles.build_subtitles(fx.clips, fx.transcript, fx.features)


# ---- timing


def _timed(fx):
    return _chunks(fx), fx.voice_frames, fx.clips.select(*CLIP, (F.col("end") - F.col("start")).alias("clip_dur"))


@query("SELECT vod_id, clip_idx, chunk_idx::INTEGER AS chunk_idx, det_start, det_end FROM vbounds")
def voice_bounds(fx):
    return timing.voice_bounds(*_timed(fx))


_R3 = lambda x: f"round(({x})::DECIMAL(24, 10), 3)::DOUBLE"
_LERP = lambda a, b: _R3(f"{a} + ({b} - {a}) * CASE WHEN len < 1 THEN 0.4 WHEN abs({b} - {a}) < 0.2 THEN 0.9 WHEN abs({b} - {a}) < 0.5 THEN 0.7 ELSE 0.5 END")
_ALIGN = f""", a0 AS (SELECT s.*, det_start, det_end, s."end" - s.start AS len FROM vseg s LEFT JOIN vbounds b ON b.vod_id = s.vod_id AND b.clip_idx = s.clip_idx AND b.chunk_idx = s.chunk_idx),
a1 AS (SELECT *, {_LERP('start', 'det_start')} AS na, {_LERP('"end"', 'det_end')} AS nb FROM a0),
a2 AS (SELECT *, CASE WHEN det_start IS NULL THEN start WHEN round(nb - na, 6) < 0.6 THEN {_R3('greatest(0, na - (0.6 - (nb - na)) / 2)')} ELSE na END AS x,
  CASE WHEN det_start IS NULL THEN "end" WHEN round(nb - na, 6) < 0.6 THEN {_R3('least(clip_dur, nb + (0.6 - (nb - na)) / 2)')} ELSE nb END AS y FROM a1)
"""


@query(sql("").rstrip() + _ALIGN + 'SELECT vod_id, clip_idx, chunk_idx::INTEGER AS chunk_idx, x AS start, y AS "end", ' + _R3("x - start") + ' AS delta_start, ' + _R3('y - "end"') + ' AS delta_end, det_start IS NULL AS fallback FROM a2', raw=True)
def align_segments(fx):
    s, v, d = _timed(fx)
    a = timing.align_segments(s, timing.voice_bounds(s, v, d), d)
    return a.select(*CLIP, "chunk_idx", "start", "end", F.col("debug.delta_start").alias("delta_start"), F.col("debug.delta_end").alias("delta_end"), F.col("debug.fallback").alias("fallback"))


@query(sql("").rstrip() + """, dip AS (SELECT s.vod_id, s.clip_idx, s.chunk_idx, round(arg_min(f.t, (f.rms, f.t)), 3) AS dip FROM vseg s JOIN vframes f ON f.vod_id = s.vod_id AND f.clip_idx = s.clip_idx
  AND f.t >= s.start + (s."end" - s.start) * 0.25 AND f.t <= s."end" - (s."end" - s.start) * 0.25 WHERE s."end" - s.start > 4 GROUP BY 1, 2, 3),
cutp AS (SELECT s.*, coalesce(dip, round(((start + "end") / 2)::DECIMAL(24, 10), 3)::DOUBLE) AS c, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM vseg s LEFT JOIN dip d ON d.vod_id = s.vod_id AND d.clip_idx = s.clip_idx AND d.chunk_idx = s.chunk_idx)
SELECT vod_id, clip_idx, start, "end", array_to_string(w, ' ') AS text FROM cutp WHERE "end" - start <= 4 UNION ALL SELECT vod_id, clip_idx, start, c, array_to_string(w[:greatest(1, len(w) // 2)], ' ') FROM cutp WHERE "end" - start > 4
UNION ALL SELECT vod_id, clip_idx, c, "end", array_to_string(w[greatest(1, len(w) // 2) + 1:], ' ') FROM cutp WHERE "end" - start > 4""", raw=True)
def split_at_dip(fx):
    s, v, _ = _timed(fx)
    none = F.lit(None).cast("struct<delta_start:double,delta_end:double,fallback:boolean>")
    out = timing.split_at_dip(s.withColumn("debug", none), v)
    return out.select(*CLIP, "start", "end", F.concat_ws(" ", subtitles.text_words(F.col("text"))).alias("text"))


@query(sql("").rstrip() + """, g0 AS (SELECT vod_id, clip_idx, chunk_idx, start, "end" + 0.45 AS e FROM ctr), g AS (SELECT *, lead(start) OVER (PARTITION BY vod_id, clip_idx ORDER BY chunk_idx) AS nxt FROM g0),
e AS (SELECT g.vod_id, g.clip_idx, g.chunk_idx, avg(rms) FILTER (t >= e AND t <= nxt) AS ge, avg(rms) FILTER ((t >= e - 0.1 AND t < e) OR (t > nxt AND t <= nxt + 0.1)) AS ce
  FROM g JOIN vframes f ON f.vod_id = g.vod_id AND f.clip_idx = g.clip_idx WHERE nxt - e < 0.15 GROUP BY 1, 2, 3),
m AS (SELECT g.*, CASE WHEN nxt - g.e < 0.15 AND NOT coalesce(CASE WHEN ce IS NULL THEN ge < 0.0075 ELSE ge < ce * 0.4 END, false) THEN round(((g.e + nxt) / 2)::DECIMAL(24, 10), 3)::DOUBLE END AS mid FROM g LEFT JOIN e ON e.vod_id = g.vod_id AND e.clip_idx = g.clip_idx AND e.chunk_idx = g.chunk_idx)
SELECT vod_id, clip_idx, chunk_idx::INTEGER AS chunk_idx, """ + _R3("coalesce(lag(mid) OVER (PARTITION BY vod_id, clip_idx ORDER BY chunk_idx), start)") + " AS start, " + _R3("coalesce(mid, e)") + ' AS "end" FROM m', raw=True)
def close_gaps(fx):
    s, v, _ = _timed(fx)
    out = timing.close_gaps(s.withColumn("end", F.col("end") + 0.45), v)
    return out.select(*CLIP, "chunk_idx", tidy(F.col("start"), 3).alias("start"), tidy(F.col("end"), 3).alias("end"))


@query(sql("").rstrip() + _ALIGN + """SELECT vod_id, clip_idx, count(*) FILTER (det_start IS NULL) AS align_fallbacks, """ + _R3("avg(abs(" + _R3("x - start") + "))") + " AS avg_delta_start_s, " + _R3('avg(abs(' + _R3('y - "end"') + '))') + " AS avg_delta_end_s FROM a2 GROUP BY 1, 2", raw=True)
def alignment_report(fx):
    s, v, d = _timed(fx)
    return timing.alignment_report(timing.align_segments(s, timing.voice_bounds(s, v, d), d))


_VOICED = renamed({n: STEPS[n] for n in ("vseg", "vhit", "vloud", "vbounds")}, {"ctr": "st_calm", **{n: f"al_{n}" for n in ("vseg", "vhit", "vloud", "vbounds")}})
_HALF = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')"


@query(sql("", {**SUBTITLES, **_VOICED}).rstrip() + _ALIGN.replace("vseg", "al_vseg").replace("vbounds", "al_vbounds") + f""", d0 AS (SELECT vod_id, clip_idx, chunk_idx, x AS start, y AS "end", text FROM a2),
dips AS (SELECT s.vod_id, s.clip_idx, s.chunk_idx, round(arg_min(f.t, (f.rms, f.t)), 3) AS dip FROM d0 s JOIN vframes f ON f.vod_id = s.vod_id AND f.clip_idx = s.clip_idx
  AND f.t >= s.start + (s."end" - s.start) * 0.25 AND f.t <= s."end" - (s."end" - s.start) * 0.25 WHERE s."end" - s.start > 4 GROUP BY 1, 2, 3),
d1 AS (SELECT s.*, coalesce(dip, {_R3('(start + "end") / 2')}) AS c, {_HALF} AS w FROM d0 s LEFT JOIN dips d ON d.vod_id = s.vod_id AND d.clip_idx = s.clip_idx AND d.chunk_idx = s.chunk_idx),
d2 AS (SELECT vod_id, clip_idx, chunk_idx AS old, 0 AS half, start, CASE WHEN "end" - start <= 4 THEN "end" ELSE c END AS "end", CASE WHEN "end" - start <= 4 THEN text ELSE array_to_string(w[:greatest(1, len(w) // 2)], ' ') END AS text FROM d1
  UNION ALL SELECT vod_id, clip_idx, chunk_idx, 1, c, "end", array_to_string(w[greatest(1, len(w) // 2) + 1:], ' ') FROM d1 WHERE "end" - start > 4),
d3 AS (SELECT *, lead(start) OVER (PARTITION BY vod_id, clip_idx ORDER BY chunk_idx) AS nxt FROM (SELECT *, (row_number() OVER (PARTITION BY vod_id, clip_idx ORDER BY old, half))::INTEGER AS chunk_idx FROM d2)),
d4 AS (SELECT g.vod_id, g.clip_idx, g.chunk_idx, avg(rms) FILTER (t >= g."end" AND t <= nxt) AS ge, avg(rms) FILTER ((t >= g."end" - 0.1 AND t < g."end") OR (t > nxt AND t <= nxt + 0.1)) AS ce
  FROM d3 g JOIN vframes f ON f.vod_id = g.vod_id AND f.clip_idx = g.clip_idx WHERE nxt - g."end" < 0.15 GROUP BY 1, 2, 3),
d5 AS (SELECT g.*, CASE WHEN nxt - g."end" < 0.15 AND NOT coalesce(CASE WHEN ce IS NULL THEN ge < 0.0075 ELSE ge < ce * 0.4 END, false) THEN {_R3('(g."end" + nxt) / 2')} END AS mid
  FROM d3 g LEFT JOIN d4 e ON e.vod_id = g.vod_id AND e.clip_idx = g.clip_idx AND e.chunk_idx = g.chunk_idx)
SELECT vod_id, clip_idx, chunk_idx, coalesce(lag(mid) OVER (PARTITION BY vod_id, clip_idx ORDER BY chunk_idx), start) AS start, coalesce(mid, "end") AS "end", text FROM d5""", raw=True)
def aligned_subtitles(fx):
    _, v, d = _timed(fx)
    return pipelines.aligned_subtitles(fx.clips, fx.transcript, fx.features, v, d).drop("debug")


# ---- real start and end


@query("SELECT vod_id, side, pos, round(t, 4) AS t, round(score, 4) AS score, active FROM scan")
def scan_windows(fx):
    return bounds.scan_windows(fx.frames, fx.durations, TRIM).select("vod_id", "side", "pos", *r4("t", "score"), "active")


_VALID = """, vp AS (SELECT s.vod_id, s.side, p.timestamp, s.off, s.n, greatest(0, trunc(p.timestamp - s.off - 2)::BIGINT) AS lo, least(s.n, trunc(p.timestamp - s.off + 2)::BIGINT) AS hi
  FROM (SELECT DISTINCT vod_id, timestamp FROM peaks) p JOIN (SELECT s.vod_id, s.side, s.off, s.scan, max(pos) + 1 AS n FROM scan c JOIN sides s ON s.vod_id = c.vod_id AND s.side = c.side GROUP BY ALL) s ON s.vod_id = p.vod_id
  WHERE p.timestamp >= s.off AND (s.side = 'tail' OR p.timestamp <= s.n)),
va AS (SELECT v.vod_id, v.side, v.timestamp FROM vp v JOIN scan c ON c.vod_id = v.vod_id AND c.side = v.side AND c.pos >= lo AND c.pos < hi WHERE hi > lo GROUP BY 1, 2, 3 HAVING avg(active::INTEGER) >= 0.3),
vd AS (SELECT v.*, coalesce((SELECT sum(length(text)) FROM transcript s WHERE s.vod_id = v.vod_id AND s.start < v.timestamp + 2 AND s."end" > v.timestamp - 2), 0) / 4.0 AS den FROM va v)
"""
EASY = Trim(frames_per_second=1.0, active_share=0.3, silence_share=0.3)


@query(sql("").rstrip() + _VALID + "SELECT vod_id, side, timestamp FROM vd WHERE den >= 0.5", raw=True)
def validate_peaks(fx):
    return bounds.validate_peaks(fx.peaks, bounds.scan_windows(fx.frames, fx.durations, EASY), fx.transcript, EASY)


@query(sql("").rstrip() + _VALID + "SELECT vod_id, min(timestamp) FILTER (side = 'head') AS start_peaks, max(timestamp) FILTER (side = 'tail') AS end_peaks FROM vd WHERE den >= 0.5 GROUP BY vod_id", raw=True)
def bounds_from_peaks(fx):
    return bounds.bounds_from_peaks(bounds.validate_peaks(fx.peaks, bounds.scan_windows(fx.frames, fx.durations, EASY), fx.transcript, EASY))


@query(sql("").rstrip() + """, said AS (SELECT t.*, least(600, total_s * 0.5) AS head_end, greatest(0, total_s - least(600, total_s * 0.5)) AS tail_start FROM transcript t JOIN durations d ON d.vod_id = t.vod_id WHERE length(trim(text)) > 3),
h AS (SELECT vod_id, min(start) AS s FROM said a WHERE start <= head_end AND (SELECT sum(length(text)) FROM transcript s WHERE s.vod_id = a.vod_id AND s.start < a.start + 30 AND s."end" > a.start) / 30.0 >= 0.5 GROUP BY vod_id),
e AS (SELECT vod_id, max("end") AS e FROM said WHERE "end" >= tail_start GROUP BY vod_id)
SELECT coalesce(h.vod_id, e.vod_id) AS vod_id, s AS start_transcript, e AS end_transcript FROM h FULL JOIN e ON h.vod_id = e.vod_id""", raw=True)
def bounds_from_transcript(fx):
    return bounds.bounds_from_transcript(fx.transcript, fx.durations, TRIM)


@query("""SELECT vod_id, min(t) AS start_energy FROM (SELECT *, avg(active::INTEGER) OVER (PARTITION BY vod_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS sh, max(pos) OVER (PARTITION BY vod_id) + 1 AS n FROM scan WHERE side = 'head')
  WHERE pos < n - 8 AND sh >= 0.3 GROUP BY vod_id""")
def start_from_energy(fx):
    return bounds.start_from_energy(bounds.scan_windows(fx.frames, fx.durations, EASY), None, EASY)


@query("""SELECT vod_id, max(t) AS end_energy FROM (SELECT *, avg(active::INTEGER) OVER (PARTITION BY vod_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS sh, max(pos) OVER (PARTITION BY vod_id) + 1 AS n FROM scan WHERE side = 'tail') x
  WHERE active AND pos > 20 AND pos <= n - 21 AND sh < 0.3 AND coalesce((SELECT sum(length(text)) FROM transcript s WHERE s.vod_id = x.vod_id AND s.start < x.t + 20 AND s."end" > x.t), 0) / 20.0 < 0.5 GROUP BY vod_id""")
def end_from_energy(fx):
    return bounds.end_from_energy(bounds.scan_windows(fx.frames, fx.durations, EASY), fx.transcript, EASY)


_TRIM = """, se AS (SELECT vod_id, min(t) AS s FROM (SELECT *, avg(active::INTEGER) OVER (PARTITION BY vod_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS sh, max(pos) OVER (PARTITION BY vod_id) + 1 AS n FROM scan WHERE side = 'head')
  WHERE pos < n - 8 AND sh >= 0.3 GROUP BY vod_id),
ee AS (SELECT vod_id, max(t) AS e FROM (SELECT *, avg(active::INTEGER) OVER (PARTITION BY vod_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS sh, max(pos) OVER (PARTITION BY vod_id) + 1 AS n FROM scan WHERE side = 'tail')
  WHERE active AND pos > 20 AND pos <= n - 21 AND sh < 0.3 GROUP BY vod_id),
tb AS (SELECT d.vod_id, d.total_s, CASE WHEN s IS NULL OR s < 30 THEN 0 ELSE round(greatest(0, s - 5), 3) END AS a, coalesce(round(least(total_s, e + 5), 3), total_s) AS b, CASE WHEN s IS NULL THEN 'fallback' ELSE 'energy' END AS sm,
  CASE WHEN e IS NULL THEN 'fallback' ELSE 'energy' END AS em FROM durations d LEFT JOIN se ON se.vod_id = d.vod_id LEFT JOIN ee ON ee.vod_id = d.vod_id),
tr AS (SELECT vod_id, total_s, CASE WHEN b <= a + 60 THEN 0 ELSE a END AS real_start, CASE WHEN b <= a + 60 THEN total_s ELSE b END AS real_end, CASE WHEN b <= a + 60 THEN 'fallback' ELSE sm END AS start_method, CASE WHEN b <= a + 60 THEN 'fallback' ELSE em END AS end_method FROM tb)
"""


@query(sql("").rstrip() + _TRIM + """SELECT vod_id, round(total_s, 3) AS total_duration_s, real_start, real_end, round(real_end - real_start, 3) AS duration_trimmed, 5.0::DOUBLE AS buffer_s, start_method, end_method,
  start_method = 'fallback' AS fallback_start, end_method = 'fallback' AS fallback_end,
  round(CASE WHEN start_method = 'energy' THEN 0.2 ELSE 0 END + CASE WHEN end_method = 'energy' THEN 0.2 ELSE 0 END + 0.15, 3)::DOUBLE AS trim_confidence FROM tr""", raw=True)
def trim_bounds(fx):
    return pipelines.real_bounds(fx.frames, fx.durations, p=EASY)


_CHARS = lambda v, a, b: f"coalesce((SELECT sum(length(text)) FROM transcript s WHERE s.vod_id = {v}.vod_id AND s.start < {b} AND s.\"end\" > {a}), 0)"


@query(sql("").rstrip() + _VALID + f""", bp AS (SELECT vod_id, min(timestamp) FILTER (side = 'head') AS sp, max(timestamp) FILTER (side = 'tail') AS ep FROM vd WHERE den >= 0.5 GROUP BY vod_id),
said AS (SELECT t.*, least(600, total_s * 0.5) AS head_end, greatest(0, total_s - least(600, total_s * 0.5)) AS tail_start FROM transcript t JOIN durations d ON d.vod_id = t.vod_id WHERE length(trim(text)) > 3),
th AS (SELECT vod_id, min(start) AS st FROM said a WHERE start <= head_end AND {_CHARS('a', 'a.start', 'a.start + 30')} / 30.0 >= 0.5 GROUP BY vod_id),
te AS (SELECT vod_id, max("end") AS et FROM said WHERE "end" >= tail_start GROUP BY vod_id),
sh AS (SELECT *, avg(active::INTEGER) OVER (PARTITION BY vod_id, side ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ahead, avg(active::INTEGER) OVER (PARTITION BY vod_id, side ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) AS quiet,
  max(pos) OVER (PARTITION BY vod_id, side) + 1 AS n FROM scan),
se AS (SELECT vod_id, min(t) AS sn FROM sh x WHERE side = 'head' AND pos < n - 8 AND ahead >= 0.3 AND {_CHARS('x', 'x.t', 'x.t + 8')} / 8.0 >= 0.5 GROUP BY vod_id),
ee AS (SELECT vod_id, max(t) AS en FROM sh x WHERE side = 'tail' AND active AND pos > 20 AND pos <= n - 21 AND quiet < 0.3 AND {_CHARS('x', 'x.t', 'x.t + 20')} / 20.0 < 0.5 GROUP BY vod_id),
t0 AS (SELECT d.vod_id, d.total_s, coalesce(sp, st, sn) AS s, coalesce(ep, et, en) AS e, CASE WHEN sp IS NOT NULL THEN 'peaks' WHEN st IS NOT NULL THEN 'transcript' WHEN sn IS NOT NULL THEN 'energy' ELSE 'fallback' END AS sm,
  CASE WHEN ep IS NOT NULL THEN 'peaks' WHEN et IS NOT NULL THEN 'transcript' WHEN en IS NOT NULL THEN 'energy' ELSE 'fallback' END AS em
  FROM durations d LEFT JOIN bp ON bp.vod_id = d.vod_id LEFT JOIN th ON th.vod_id = d.vod_id LEFT JOIN te ON te.vod_id = d.vod_id LEFT JOIN se ON se.vod_id = d.vod_id LEFT JOIN ee ON ee.vod_id = d.vod_id),
t1 AS (SELECT *, CASE WHEN s IS NULL OR s < 30 THEN 0 ELSE round(greatest(0, s - 5), 3) END AS a, CASE WHEN e IS NOT NULL AND {_CHARS('t', 't.e', 't.e + 15')} / 15.0 >= 0.25 THEN 10 ELSE 5 END AS buffer FROM t0 t),
t2 AS (SELECT *, CASE WHEN e IS NULL THEN round(total_s, 3) ELSE round(least(total_s, e + buffer), 3) END AS b FROM t1),
t3 AS (SELECT *, (SELECT max(x."end") FROM said x WHERE x.vod_id = t.vod_id AND x."end" <= t.b + 30) AS last FROM t2 t),
t4 AS (SELECT *, CASE WHEN last IS NOT NULL AND abs(b - last) > 30 THEN round(least(total_s, last + buffer), 3) ELSE b END AS z FROM t3),
t5 AS (SELECT vod_id, total_s, CASE WHEN z <= a + 60 THEN 0 ELSE a END AS real_start, CASE WHEN z <= a + 60 THEN total_s ELSE z END AS real_end, CASE WHEN z <= a + 60 THEN 'fallback' ELSE sm END AS sm, CASE WHEN z <= a + 60 THEN 'fallback' ELSE em END AS em FROM t4),
t6 AS (SELECT *, {_CHARS('t', 't.real_start', 't.real_start + 30')} / 30.0 AS ds, {_CHARS('t', 'greatest(0, t.real_end - 30)', 't.real_end')} / greatest(real_end - greatest(0, real_end - 30), 0.001) AS de FROM t5 t)
SELECT vod_id, round(total_s, 3) AS total_duration_s, real_start, real_end, round(real_end - real_start, 3) AS duration_trimmed, 5.0::DOUBLE AS buffer_s, sm AS start_method, em AS end_method, sm = 'fallback' AS fallback_start, em = 'fallback' AS fallback_end,
  round(least(1, CASE sm WHEN 'peaks' THEN 0.2 WHEN 'energy' THEN 0.1 WHEN 'transcript' THEN 0.08 ELSE 0 END + CASE em WHEN 'peaks' THEN 0.2 WHEN 'energy' THEN 0.1 WHEN 'transcript' THEN 0.08 ELSE 0 END
  + CASE WHEN ds >= 0.5 THEN 0.2 WHEN ds >= 0.25 THEN 0.1 ELSE 0 END + CASE WHEN de >= 0.25 THEN 0.2 WHEN de > 0 THEN 0.1 ELSE 0 END + CASE WHEN sm <> 'fallback' THEN 0.1 ELSE 0 END + CASE WHEN em <> 'fallback' THEN 0.1 ELSE 0 END), 3)::DOUBLE AS trim_confidence
FROM t6""", raw=True)
def trim_bounds_all(fx):
    return pipelines.real_bounds(fx.frames, fx.durations, fx.transcript, fx.peaks, EASY)


@query(sql("").rstrip() + """, b AS (SELECT vod_id, total_s * 0.1 AS real_start, total_s * 0.9 AS real_end, CASE vod_id % 3 WHEN 0 THEN 'peaks' WHEN 1 THEN 'energy' ELSE 'fallback' END AS sm, CASE vod_id % 2 WHEN 0 THEN 'transcript' ELSE 'fallback' END AS em FROM durations),
d AS (SELECT *, coalesce((SELECT sum(length(text)) FROM transcript s WHERE s.vod_id = b.vod_id AND s.start < b.real_start + 30 AND s."end" > b.real_start), 0) / 30.0 AS ds,
  coalesce((SELECT sum(length(text)) FROM transcript s WHERE s.vod_id = b.vod_id AND s.start < b.real_end AND s."end" > greatest(0, b.real_end - 30)), 0) / (b.real_end - greatest(0, b.real_end - 30)) AS de FROM b)
SELECT vod_id, round(least(1, CASE sm WHEN 'peaks' THEN 0.2 WHEN 'energy' THEN 0.1 ELSE 0 END + CASE em WHEN 'transcript' THEN 0.08 ELSE 0 END + CASE WHEN ds >= 0.5 THEN 0.2 WHEN ds >= 0.25 THEN 0.1 ELSE 0 END
  + CASE WHEN de >= 0.25 THEN 0.2 WHEN de > 0 THEN 0.1 ELSE 0 END + CASE WHEN sm <> 'fallback' THEN 0.1 ELSE 0 END + CASE WHEN em <> 'fallback' THEN 0.1 ELSE 0 END), 3)::DOUBLE AS trim_confidence FROM d""", raw=True)
def trim_confidence(fx):
    v = F.col("vod_id")
    b = fx.durations.select(
        "vod_id", (F.col("total_s") * 0.1).alias("real_start"), (F.col("total_s") * 0.9).alias("real_end"),
        F.when(v % 3 == 0, "peaks").when(v % 3 == 1, "energy").otherwise("fallback").alias("start_method"), F.when(v % 2 == 0, "transcript").otherwise("fallback").alias("end_method"),
    )
    return bounds.trim_confidence(b, fx.transcript, TRIM).select("vod_id", "trim_confidence")


QUERIES["content_richness"] = QUERIES.pop("content_richness_q")
