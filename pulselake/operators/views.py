"""The six base views: daily metrics, workouts with heart rate, and the merged night table."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.calendar import between_days, day, elapsed_seconds, ts_between_days
from pulselake.functions.numeric import sql_round, to_long
from pulselake.operators.intervals import records_within
from pulselake.tables import Tables

WORKOUT_KEYS = [
    "start_date",
    "end_date",
    "workout_activity_type",
    "duration",
    "duration_unit",
    "total_distance",
    "total_distance_unit",
    "total_energy_burned",
    "total_energy_burned_unit",
]

# A device night counts from more than an hour in one stretch.
MIN_DEVICE_NIGHT_SECONDS = 3600


def when_type(record_type: str) -> Column:
    """``value`` of one record type, NULL for others: the building block of fused aggregations."""
    return F.when(F.col("record_type") == record_type, F.col("value"))


def by_day(records: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregate records per subject and calendar day of their start."""
    return records.groupBy("subject_id", day(F.col("start_date")).alias("date")).agg(*aggregates)


def daily_steps(records: DataFrame) -> DataFrame:
    steps = records.where(F.col("record_type") == "StepCount")
    return by_day(steps, to_long(F.sum("value")).alias("steps"))


def daily_heart_rate(records: DataFrame) -> DataFrame:
    beats = records.where(F.col("record_type") == "HeartRate")
    return by_day(
        beats,
        sql_round(F.avg("value"), 1).alias("avg_hr"),
        sql_round(F.min("value"), 1).alias("min_hr"),
        sql_round(F.max("value"), 1).alias("max_hr"),
    )


def daily_resting_hr(records: DataFrame) -> DataFrame:
    resting = records.where(F.col("record_type") == "RestingHeartRate")
    return by_day(resting, sql_round(F.avg("value"), 1).alias("resting_hr"))


def daily_summary(t: Tables) -> DataFrame:
    """Ring values with the day's steps, distance and resting heart rate.

    The three record metrics come from one scan and one shuffle; a metric without rows that day stays NULL.
    """
    metrics = by_day(
        t.of_type("StepCount", "DistanceWalkingRunning", "RestingHeartRate"),
        to_long(F.sum(when_type("StepCount"))).alias("steps"),
        sql_round(F.sum(when_type("DistanceWalkingRunning")), 2).alias("distance"),
        sql_round(F.avg(when_type("RestingHeartRate")), 1).alias("resting_hr"),
    )
    rings = t.activity.select(
        "subject_id",
        F.col("date_components").alias("date"),
        "active_energy_burned",
        "active_energy_burned_goal",
        "apple_exercise_time",
        "apple_exercise_time_goal",
        "apple_stand_hours",
        "apple_stand_hours_goal",
    )
    return rings.join(metrics, ["subject_id", "date"], "left")


def workout_summary(t: Tables) -> DataFrame:
    """Workouts with heart rate and running speed of the records wholly inside them; equal workouts merge.

    Each workout also enters the aggregation as a row without a value, which gives LEFT JOIN results from one
    group-by instead of joining the aggregate back.
    """
    keys = ["subject_id", *WORKOUT_KEYS]
    workouts = t.workouts.select(*keys)
    pairs = records_within(workouts, t.of_type("HeartRate", "RunningSpeed"), both_ends=True)
    rows = pairs.select(*keys, "record_type", "value").unionByName(workouts, allowMissingColumns=True)
    heart, speed = when_type("HeartRate"), when_type("RunningSpeed")
    return rows.groupBy(*keys).agg(
        sql_round(F.avg(heart), 1).alias("avg_heart_rate"),
        sql_round(F.min(heart), 1).alias("min_heart_rate"),
        sql_round(F.max(heart), 1).alias("max_heart_rate"),
        sql_round(F.avg(speed), 2).alias("avg_speed"),
    )


def app_nights(sleep: DataFrame) -> DataFrame:
    return sleep.select(
        "subject_id",
        day(F.col("start_time")).alias("date"),
        F.lit("sleep_cycle").alias("source"),
        "sleep_quality",
        F.col("time_asleep_seconds").alias("duration_seconds"),
        "deep_seconds",
        "light_seconds",
        "dream_seconds",
        "awake_seconds",
        "heart_rate_bpm",
    )


def device_nights(records: DataFrame) -> DataFrame:
    """Per day, the longest single sleep segment of the device."""
    longest = F.max(elapsed_seconds(F.col("start_date"), F.col("end_date")))
    nights = by_day(
        records.where(F.col("record_type") == "SleepAnalysis"),
        longest.alias("duration_seconds"),
    )
    return nights.where(F.col("duration_seconds") > MIN_DEVICE_NIGHT_SECONDS)


def sleep_combined(t: Tables) -> DataFrame:
    """App nights, plus device nights on dates the app did not record.

    "Not recorded" follows SQL ``NOT IN``: one app night without a date hides all device nights of that subject.
    """
    app = app_nights(t.sleep)
    dates = app.select("subject_id", "date").distinct()
    undated = dates.where(F.col("date").isNull()).select("subject_id")
    device = (
        device_nights(t.records)
        .join(dates, ["subject_id", "date"], "left_anti")
        .join(undated, "subject_id", "left_anti")
        .withColumn("source", F.lit("apple_health"))
    )
    return app.unionByName(device, allowMissingColumns=True)


def nights_between(t: Tables, s: date, e: date) -> DataFrame:
    """``sleep_combined`` nights dated in [s, e] with a positive duration.

    The date range is pushed to both sources by hand where that cannot change the outcome: device records are cut
    to the range, app nights keep undated rows because those decide whether device nights count.
    """
    ranged = replace(
        t,
        records=t.records.where(ts_between_days(F.col("start_date"), s, e)),
        sleep=t.sleep.where(ts_between_days(F.col("start_time"), s, e) | F.col("start_time").isNull()),
    )
    return sleep_combined(ranged).where(between_days(F.col("date"), s, e) & (F.col("duration_seconds") > 0))
