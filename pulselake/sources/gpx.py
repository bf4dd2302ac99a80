"""GPX workout tracks, flattened to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.numeric import safe_double
from pulselake.sources.export_xml import subject_column

_EXTENSIONS = {"speed": "speed", "course": "course", "hAcc": "horiz_accuracy", "vAcc": "vert_accuracy"}

# One track: text everywhere, so one odd number spoils only itself.
TRACK_SCHEMA = (
    "name string, trkseg array<struct<trkpt: array<struct<"
    "_lat: string, _lon: string, ele: string, time: string, "
    "extensions: struct<speed: string, course: string, hAcc: string, vAcc: string>>>>>"
)


def utc_clock(text: Column) -> Column:
    """A timestamp text as UTC wall clock, whatever the session time zone; a text without a zone is taken as UTC.

    Zoned instants are counted in microseconds from the epoch, so hours that a local clock shows twice or never stay
    apart.
    """
    zoned = text.rlike(r"(?i)(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})$") & text.contains(":")
    seconds = (F.unix_micros(text.try_cast("timestamp")) / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.when(zoned, epoch + F.make_dt_interval(secs=seconds)).otherwise(text.try_cast("timestamp_ntz"))


def flatten_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks (subject_id, gpx_file, name, trkseg) to points with their segment and place in it, as in the file."""
    track = ["subject_id", "gpx_file", "workout_name"]
    segments = tracks.withColumnRenamed("name", "workout_name").select(*track, F.posexplode("trkseg").alias("segment", "seg"))
    points = segments.select(*track, "segment", F.posexplode("seg.trkpt").alias("point_no", "p"))
    return points.select(
        "subject_id",
        "gpx_file",
        "workout_name",
        F.col("segment").cast("bigint").alias("segment"),
        F.col("point_no").cast("bigint").alias("point_no"),
        utc_clock(F.col("p.time")).alias("recorded_at"),
        safe_double(F.col("p._lat")).alias("latitude"),
        safe_double(F.col("p._lon")).alias("longitude"),
        safe_double(F.col("p.ele")).alias("elevation"),
        *[safe_double(F.col(f"p.extensions.{tag}")).alias(name) for tag, name in _EXTENSIONS.items()],
    )


def read_routes(spark: SparkSession, path: str, subject_id: int | None = None) -> DataFrame:
    """Points of every ``.gpx`` file under ``path``; an unreadable file yields no rows.

    Track files are small and many, so a task takes whole files; Spark packs several into one task.
    """
    tracks = (
        spark.read.format("xml")
        .schema(TRACK_SCHEMA)
        .option("rowTag", "trk")
        .option("ignoreNamespace", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.gpx")
        .load(path)
    )
    named = tracks.select(
        subject_column(subject_id).alias("subject_id"),
        F.col("_metadata.file_name").alias("gpx_file"),
        "name",
        "trkseg",
    )
    return flatten_tracks(named)
