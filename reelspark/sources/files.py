"""Reading and writing stage tables; catalogue bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

TRANSCRIPT = "array<struct<start:double,end:double,text:string>>"
PEAKS = "array<struct<timestamp:double,intensity:double>>"


def _arrays(spark: SparkSession, path: str, kind: str, pattern: str) -> DataFrame:
    """One row per element of the JSON array in each file; vod_id is the directory that `pattern` captures."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("vod_id"), F.from_json("value", kind).alias("rows"))
    return files.select("vod_id", F.posexplode("rows").alias("seq", "row")).select("vod_id", F.col("seq").cast("long").alias("seq"), "row.*")


def read_transcripts(spark: SparkSession, path: str, pattern: str = r"([^/]+)/transcripts/[^/]+$") -> DataFrame:
    return _arrays(spark, path, TRANSCRIPT, pattern)


def read_peaks(spark: SparkSession, path: str, pattern: str = r"([^/]+)/analysis/[^/]+$") -> DataFrame:
    return _arrays(spark, path, PEAKS, pattern).drop("seq")


def write_stage(df: DataFrame, name: str, path: str, form: str = "parquet", buckets: int | None = None) -> None:
    """Write a stage under path/name by vod_id, or by a hash bucket of it where there are too many for one folder each.
    Only partitions present in df are overwritten."""
    key = "vod_id"
    if buckets:
        df, key = df.withColumn("vod_bucket", F.pmod(F.xxhash64("vod_id"), F.lit(buckets))), "vod_bucket"
    df = df.repartition(key).sortWithinPartitions("vod_id") if buckets else df
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).format(form).save(f"{path}/{name}")


def vod_id_from_url(df: DataFrame, url: str = "url", today: str = "1970-01-01") -> DataFrame:
    part = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return df.withColumn("vod_id", F.coalesce(part(r"/videos/(\d+)"), part(r"(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})"), F.lit(today)))


def pending_vods(requested: DataFrame, done: DataFrame, key: list[str] | None = None, min_bytes: int = 0) -> DataFrame:
    """Requested rows that are not yet materialised with more than min_bytes."""
    return requested.join(done.filter(F.col("size") > min_bytes), key or ["vod_id"], "left_anti")


def crop_x(position: str = "center", offset_px: int = 0) -> Column:
    base = {"left": "0", "right": "iw-ih*9/16"}.get(position, "(iw-ih*9/16)/2")
    return F.lit(base if not offset_px else f"({base})+({offset_px})")


def clip_manifest(clips: DataFrame, order: list, position: str = "center", offset_px: int = 0) -> DataFrame:
    """A cut list for an encoder: 1-based index, start, duration, output names, crop."""
    n = F.row_number().over(W.partitionBy("vod_id").orderBy(*order))
    c = clips.withColumn("clip_index", n)
    return c.select(
        "vod_id", "clip_index", "start", F.round(F.col("end") - F.col("start"), 3).alias("duration"), F.format_string("clip_%02d.mp4", "clip_index").alias("clip_file"),
        F.format_string("vertical_%03d.mp4", "clip_index").alias("vertical_file"), F.lit("ih*9/16").alias("crop_w"), crop_x(position, offset_px).alias("crop_x"),
        F.lit(1080).alias("out_w"), F.lit(1920).alias("out_h"),
    )


def run_metadata(vods: DataFrame, clips: DataFrame, verticals: DataFrame, date: str = "1970-01-01") -> DataFrame:
    """vods: (vod_id, vod_url, vod_title, duration_s)."""
    count = lambda df, out: df.groupBy("vod_id").agg(F.count("*").alias(out))
    return vods.join(count(clips, "total_clips"), "vod_id", "left").join(count(verticals, "total_vertical"), "vod_id", "left").select(
        "vod_id", F.to_date(F.lit(date)).alias("date"), F.coalesce("vod_url", F.lit("")).alias("vod_url"), F.coalesce("vod_title", F.lit("")).alias("vod_title"),
        F.coalesce("total_clips", F.lit(0)).alias("total_clips"), F.coalesce("total_vertical", F.lit(0)).alias("total_vertical"),
        F.coalesce(F.round("duration_s"), F.lit(0)).cast("long").alias("duration_original_sec"),
    )
