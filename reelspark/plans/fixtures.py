"""Adapters: the stage tables of this library, derived by Spark from the benchmark tables.

frames from lineitem, peaks from events, transcripts from conversations, audio chunks from embeddings; all keyed by VOD.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import strip
from ..operators import ranking, simple_windows
from ..sources.stages import stage

MOST = simple_windows.MOST
LINE_KEY = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def frames(self) -> DataFrame:
        order = W.partitionBy("l_suppkey").orderBy(*LINE_KEY)
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("vod_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), (F.col("l_quantity") / 50.0).alias("rms")
        )

    @cached_property
    def durations(self) -> DataFrame:
        return self.frames.groupBy("vod_id").agg(F.count("*").cast("double").alias("total_s"))

    @cached_property
    def transcript(self) -> DataFrame:
        parts = self.table("conversations").select(F.col("conv_id").alias("vod_id"), "turn", F.posexplode(F.split("text", r"\. |\n")).alias("pos", "raw"))
        said = parts.withColumn("raw", strip(F.col("raw"))).filter("raw <> ''")
        order = W.partitionBy("vod_id").orderBy("turn", "pos")
        n = F.greatest(F.length("raw"), F.lit(3))
        step = 2 * n + 15 + 75 * (F.length("raw") % 7)
        before = F.coalesce(F.sum(step).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        timed = said.select("vod_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), before.alias("a"), n.alias("n"), "raw")
        text = F.concat(
            F.when(F.col("seq") % 11 == 0, "por cierto ").otherwise(""), "raw", F.when(F.col("seq") % 5 == 0, "!").otherwise(""), F.when(F.col("seq") % 7 == 0, "?").otherwise("")
        )
        a = F.col("a").cast("double")
        return stage(timed.select("vod_id", "seq", F.round(a / 30.0, 3).alias("start"), F.round((a + 2 * F.col("n")) / 30.0, 3).alias("end"), text.alias("text")), "transcript")

    @cached_property
    def raw_transcript(self) -> DataFrame:
        junk = self.transcript.filter("seq % 13 = 5").withColumn("text", F.lit(" ...\n"))
        return self.transcript.withColumn("text", F.concat(F.lit("\t"), "text", F.lit(" \n"))).unionByName(junk)

    @cached_property
    def peaks(self) -> DataFrame:
        e = self.table("events").select(
            F.col("user_id").alias("vod_id"), F.round(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))") / F.lit(3600e6), 3).alias("timestamp"),
            F.round(F.sqrt(F.col("value") / F.max("value").over(W.partitionBy("user_id"))), 4).alias("intensity"),
        )
        return stage(e, "peaks")

    @cached_property
    def audio_chunks(self) -> DataFrame:
        order = W.partitionBy("label").orderBy("vec_id")
        return self.table("embeddings").select(F.col("label").cast("long").alias("vod_id"), (F.row_number().over(order) - 1).cast("long").alias("chunk_idx"), F.col("embedding").cast("array<float>").alias("samples"))

    @cached_property
    def clip_chunks(self) -> DataFrame:
        """Audio chunks of clips: each VOD's audio, cut in two clips."""
        cut = self.audio_chunks.withColumn("clip_idx", (F.col("chunk_idx") % 2 + 1).cast("int"))
        return cut.select("vod_id", "clip_idx", F.floor(F.col("chunk_idx") / 2).alias("chunk_idx"), "samples")

    @cached_property
    def voice_frames(self) -> DataFrame:
        """A tenth of a second a frame, the same for all clips of each VOD, from lineitem."""
        return self.frames.select("vod_id", "frame_idx", F.round(F.col("frame_idx") * 0.1 + 0.05, 3).alias("t"), (F.col("rms") / 10).alias("rms"))

    @cached_property
    def windows(self) -> DataFrame:
        """Peaks less than 9 s apart, as windows with their peaks (a plain stand-in for momentum sessions)."""
        w = W.partitionBy("vod_id").orderBy("timestamp", "intensity")
        new = F.when(F.col("timestamp") - F.lag("timestamp").over(w) < 9.0, 0).otherwise(1)
        runs = self.peaks.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        g = runs.groupBy("vod_id", "run").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.array_sort(F.collect_list(F.struct("timestamp", "intensity"))).alias("group_peaks"))
        start = F.round(F.greatest(F.lit(0.0), F.col("lo") - 10), 3)
        return g.select("vod_id", (F.col("run") - 1).cast("long").alias("idx"), start.alias("start"), F.round(F.least(F.col("hi") + 15, start + 120), 3).alias("end"), "group_peaks")

    @cached_property
    def clips(self) -> DataFrame:
        """Simple clips: one window per peak, of as many peaks as a VOD may have candidates, numbered by start."""
        best = F.row_number().over(W.partitionBy("vod_id").orderBy(F.desc("intensity"), "timestamp"))
        top = self.peaks.withColumn("_n", best).filter(F.col("_n") <= MOST)
        pre, post = simple_windows.before_and_after()
        c = top.select("vod_id", F.round(F.greatest(F.lit(0.0), F.col("timestamp") - pre), 3).alias("start"), F.round(F.col("timestamp") + post, 3).alias("end"), F.col("timestamp").alias("peak_timestamp"), "intensity")
        return ranking.numbered(c).withColumn("clip_idx", F.col("clip_idx").cast("int"))

    @cached_property
    def features(self) -> DataFrame:
        return self.clips.select("vod_id", "clip_idx", "intensity", F.lit(0.6).alias("text_density"), F.lit(True).alias("highlight_enabled"))
