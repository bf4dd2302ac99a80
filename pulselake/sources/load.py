"""From an export folder to stored tables, and what was loaded."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.operators.profile import upsert_profile
from pulselake.sources.export_xml import (
    listed_subjects,
    parse_activity,
    parse_profile,
    parse_records,
    parse_workouts,
    read_tags,
)
from pulselake.sources.gpx import read_routes
from pulselake.sources.sleep_csv import read_nights
from pulselake.tables import SCHEMAS, Tables, empty_tables

TOP_RECORD_TYPES = 15


def read_export(
    spark: SparkSession,
    path: str,
    sleep_path: str | None = None,
    subject_id: int | None = None,
    profile: DataFrame | None = None,
    staging: str | None = None,
) -> Tables:
    """All tables of the (unpacked) exports under ``path``, lazily.

    One subject per call with ``subject_id``, or many at once from folders named ``subject_id=<n>``. An existing
    ``profile`` is kept and updated from the export. Storing the tables scans the XML once per kind of element; with
    a shared ``staging`` folder the few tags that are not records are written there first, which saves two scans.
    """
    empty = empty_tables(spark)
    tags = read_tags(spark, path, subject_id)
    others = tags
    if staging:
        folder = f"{staging}/tags-{uuid4().hex}"
        tags.where(F.col("tag").rlike(r"^(Workout|ActivitySummary|Me)\s")).write.parquet(folder)
        others = spark.read.schema(tags.schema).parquet(folder)
    found = parse_profile(others)
    tables = {
        "records": parse_records(tags),
        "workouts": parse_workouts(others),
        "activity": parse_activity(others),
        "route_points": read_routes(spark, path, subject_id),
        "sleep": read_nights(spark, sleep_path, subject_id) if sleep_path else empty.sleep,
        "profile": upsert_profile(empty.profile if profile is None else profile, found),
    }
    everyone = [listed_subjects(spark, path, subject_id)]
    if sleep_path:
        everyone.append(listed_subjects(spark, sleep_path, subject_id, "*.csv"))
    subjects = reduce(DataFrame.unionByName, everyone).distinct()
    return Tables(**tables, subjects=subjects)


def row_counts(t: Tables) -> DataFrame:
    """Rows per table."""
    counts = [
        getattr(t, name).groupBy().agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name in SCHEMAS
    ]
    return reduce(DataFrame.unionByName, counts)


def top_record_types(records: DataFrame, top: int = TOP_RECORD_TYPES) -> DataFrame:
    """The most frequent record types over all subjects; equal counts in order of name."""
    counts = records.groupBy("record_type").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), F.asc_nulls_last("record_type")).limit(top)
