"""Daily and calendar analytics: one row per subject and day, week, month or weekday."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.calendar import (
    between_days,
    date_lit,
    day,
    day_name,
    day_of_week,
    day_spine,
    elapsed_seconds,
    month_start,
    ts_between_days,
    week_start,
)
from pulselake.functions.numeric import half_even, safe_double, sql_round, to_long
from pulselake.operators.profile import profile_wide
from pulselake.operators.views import by_day, daily_steps, nights_between, when_type
from pulselake.tables import Tables

# Pounds to kilograms, inches to metres, default maximum heart rate, zone bounds as shares of it.
KG_PER_LB = 0.453592
M_PER_INCH = 0.0254
DEFAULT_MAX_HR = 190
ZONE_BOUNDS = (0.5, 0.6, 0.7, 0.85)

_AGGREGATES = {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max}


def trailing_days(rows: int):
    """The last ``rows`` daily rows of a subject. Only for frames already aggregated to one row per day."""
    return Window.partitionBy("subject_id").orderBy("date").rowsBetween(-(rows - 1), 0)


def records_between(t: Tables, s: date, e: date, *record_types: str) -> DataFrame:
    return t.of_type(*record_types).where(ts_between_days(F.col("start_date"), s, e))


def workouts_between(t: Tables, s: date, e: date) -> DataFrame:
    return t.workouts.where(ts_between_days(F.col("start_date"), s, e))


def steps_series(t: Tables, s: date, e: date) -> DataFrame:
    steps = daily_steps(records_between(t, s, e, "StepCount"))
    return steps.withColumn("steps_7d_avg", to_long(F.avg("steps").over(trailing_days(7))))


def heart_rate_series(t: Tables, s: date, e: date) -> DataFrame:
    """Daily heart rate with resting heart rate, on days that have heart-rate samples: one scan for both."""
    heart, resting = when_type("HeartRate"), when_type("RestingHeartRate")
    both = by_day(
        records_between(t, s, e, "HeartRate", "RestingHeartRate"),
        sql_round(F.avg(heart), 1).alias("avg_hr"),
        sql_round(F.min(heart), 1).alias("min_hr"),
        sql_round(F.max(heart), 1).alias("max_hr"),
        sql_round(F.avg(resting), 1).alias("resting_hr"),
        F.count_if(F.col("record_type") == "HeartRate").alias("_samples"),
    )
    return both.where(F.col("_samples") > 0).drop("_samples")


def rings_series(t: Tables, s: date, e: date) -> DataFrame:
    return t.activity.where(between_days(F.col("date_components"), s, e)).select(
        "subject_id",
        F.col("date_components").alias("date"),
        F.col("active_energy_burned").alias("energy"),
        F.col("active_energy_burned_goal").alias("energy_goal"),
        F.col("apple_exercise_time").alias("exercise"),
        F.col("apple_exercise_time_goal").alias("exercise_goal"),
        F.col("apple_stand_hours").alias("stand"),
        F.col("apple_stand_hours_goal").alias("stand_goal"),
    )


def weekday_profile(t: Tables, s: date, e: date) -> DataFrame:
    """Average steps, workout minutes per workout day and sleep hours for each weekday that has steps."""
    steps = (
        daily_steps(records_between(t, s, e, "StepCount"))
        .groupBy("subject_id", day_of_week(F.col("date")).alias("dow"))
        .agg(F.avg("steps").alias("steps"))
    )
    # Minutes per day first: the distinct-day count becomes a plain row count.
    workouts = (
        workout_minutes_by_day(workouts_between(t, s, e))
        .groupBy("subject_id", day_of_week(F.col("date")).alias("dow"))
        .agg((F.sum("workout_min") / F.count(F.lit(1))).alias("workout_min"))
    )
    sleep = (
        nights_between(t, s, e)
        .groupBy("subject_id", day_of_week(F.col("date")).alias("dow"))
        .agg((F.avg("duration_seconds") / 3600.0).alias("sleep_hrs"))
    )
    return (
        steps.join(workouts, ["subject_id", "dow"], "left")
        .join(sleep, ["subject_id", "dow"], "left")
        .select(
            "subject_id",
            "dow",
            day_name(F.col("dow")).alias("day"),
            to_long(sql_round(F.coalesce("steps", F.lit(0.0)))).alias("avg_steps"),
            sql_round(F.coalesce("workout_min", F.lit(0.0)), 1).alias("avg_workout_min"),
            sql_round(F.coalesce("sleep_hrs", F.lit(0.0)), 1).alias("avg_sleep_hrs"),
        )
    )


def workout_minutes_by_day(workouts: DataFrame) -> DataFrame:
    return workouts.groupBy("subject_id", day(F.col("start_date")).alias("date")).agg(
        F.sum("duration").alias("workout_min")
    )


def monthly_summary(t: Tables, s: date, e: date) -> DataFrame:
    """One row per subject and month of the range, with or without data."""
    key = ["subject_id", "month"]
    months = t.subjects.select(
        "subject_id",
        F.explode(F.array_distinct(F.transform(day_spine(s, e), month_start))).alias("month"),
    )
    # Four record metrics from one scan: days first (steps and resting rate average over days), then months.
    per_day = by_day(
        records_between(t, s, e, "StepCount", "RestingHeartRate", "VO2Max", "HeartRateVariabilitySDNN"),
        to_long(F.sum(when_type("StepCount"))).alias("steps"),
        sql_round(F.avg(when_type("RestingHeartRate")), 1).alias("resting_hr"),
        F.sum(when_type("VO2Max")).alias("vo2_sum"),
        F.count(when_type("VO2Max")).alias("vo2_n"),
        F.sum(when_type("HeartRateVariabilitySDNN")).alias("hrv_sum"),
        F.count(when_type("HeartRateVariabilitySDNN")).alias("hrv_n"),
    )
    measures = per_day.groupBy("subject_id", month_start(F.col("date")).alias("month")).agg(
        F.sum("steps").alias("total_steps"),
        to_long(sql_round(F.avg("steps"))).alias("avg_daily_steps"),
        sql_round(F.avg("resting_hr"), 1).alias("avg_resting_hr"),
        sql_round(F.try_divide(F.sum("vo2_sum"), F.sum("vo2_n")), 1).alias("avg_vo2max"),
        sql_round(F.try_divide(F.sum("hrv_sum"), F.sum("hrv_n")), 1).alias("avg_hrv"),
    )
    workouts = (
        workouts_between(t, s, e)
        .groupBy("subject_id", month_start(day(F.col("start_date"))).alias("month"))
        .agg(
            F.count(F.lit(1)).alias("workouts"),
            sql_round(F.sum("duration")).alias("total_workout_min"),
        )
    )
    sleep = (
        nights_between(t, s, e)
        .groupBy("subject_id", month_start(F.col("date")).alias("month"))
        .agg(sql_round(F.avg("duration_seconds") / 3600.0, 1).alias("avg_sleep_hrs"))
    )
    joined = months.join(measures, key, "left").join(workouts, key, "left").join(sleep, key, "left")
    return joined.select(
        "subject_id",
        F.date_format("month", "yyyy-MM").alias("month"),
        "total_steps",
        "avg_daily_steps",
        "workouts",
        "total_workout_min",
        "avg_sleep_hrs",
        "avg_resting_hr",
        "avg_vo2max",
        "avg_hrv",
    )


def correlation_rows(t: Tables, s: date, e: date) -> DataFrame:
    """Per day with steps: resting heart rate, longest night, best quality and workout minutes side by side."""
    key = ["subject_id", "date"]
    measures = by_day(
        records_between(t, s, e, "StepCount", "RestingHeartRate"),
        to_long(F.sum(when_type("StepCount"))).alias("steps"),
        sql_round(F.avg(when_type("RestingHeartRate")), 1).alias("resting_hr"),
    ).where(F.col("steps").isNotNull())
    sleep = (
        nights_between(t, s, e)
        .groupBy(*key)
        .agg(
            (F.max("duration_seconds") / 3600.0).alias("sleep_hrs"),
            F.max("sleep_quality").alias("sleep_quality"),
        )
    )
    workouts = workout_minutes_by_day(workouts_between(t, s, e))
    return (
        measures.join(sleep, key, "left")
        .join(workouts, key, "left")
        .select(*key, "steps", "resting_hr", "sleep_hrs", "sleep_quality", "workout_min")
    )


def daily_record_series(
    t: Tables, s: date, e: date, record_type: str, agg: str = "AVG", ma_window: int = 7
) -> DataFrame:
    """Daily aggregate of a record type with the trailing mean of the unrounded aggregate."""
    if agg not in _AGGREGATES:
        raise ValueError(f"agg must be one of the supported SQL aggregates, not {agg!r}")
    if not isinstance(ma_window, int) or isinstance(ma_window, bool) or ma_window < 1:
        raise ValueError(f"ma_window must be a positive whole number of rows, not {ma_window!r}")
    daily = by_day(records_between(t, s, e, record_type), _AGGREGATES[agg]("value").alias("raw"))
    return daily.select(
        "subject_id",
        "date",
        sql_round(F.col("raw"), 2).alias("val"),
        sql_round(F.avg("raw").over(trailing_days(ma_window)), 2).alias("ma"),
    )


def vo2max_series(t: Tables, s: date, e: date) -> DataFrame:
    return daily_record_series(t, s, e, "VO2Max", ma_window=30)


def hrv_series(t: Tables, s: date, e: date) -> DataFrame:
    return daily_record_series(t, s, e, "HeartRateVariabilitySDNN", ma_window=7)


def respiratory_series(t: Tables, s: date, e: date) -> DataFrame:
    return daily_record_series(t, s, e, "RespiratoryRate", ma_window=7)


def walking_speed_series(t: Tables, s: date, e: date) -> DataFrame:
    return daily_record_series(t, s, e, "WalkingSpeed", ma_window=14)


def flights_series(t: Tables, s: date, e: date) -> DataFrame:
    return daily_record_series(t, s, e, "FlightsClimbed", agg="SUM", ma_window=7)


def as_percent(value: Column) -> Column:
    """Oxygen saturation is stored as a fraction by some sources and as a percentage by others."""
    return F.when(value <= 1, value * 100).otherwise(value)


def spo2_series(t: Tables, s: date, e: date) -> DataFrame:
    pct = as_percent(F.col("value"))
    return by_day(
        records_between(t, s, e, "OxygenSaturation"),
        sql_round(F.avg(pct), 1).alias("avg_pct"),
        sql_round(F.min(pct), 1).alias("min_pct"),
    )


def weight_series(t: Tables, s: date, e: date) -> DataFrame:
    return by_day(records_between(t, s, e, "BodyMass"), sql_round(F.avg("value"), 1).alias("weight"))


def bmi_series(t: Tables, s: date, e: date, height_in: float | None = None) -> DataFrame:
    """BMI per weighing day and its 7-row mean. Height comes from the profile unless given; none, no rows."""
    daily = by_day(records_between(t, s, e, "BodyMass"), F.avg("value").alias("pounds"))
    if height_in is not None:
        sized = daily.withColumn("height", F.lit(float(height_in)))
    else:
        heights = profile_wide(t.profile).select("subject_id", safe_double(F.col("height_in")).alias("height"))
        sized = daily.join(heights, "subject_id", "inner")
    metres = F.col("height") * F.lit(M_PER_INCH)
    bmi = sized.where(F.col("height") != 0).select(
        "subject_id",
        "date",
        sql_round(F.col("pounds") * F.lit(KG_PER_LB) / (metres * metres), 1).alias("bmi"),
    )
    return bmi.withColumn("bmi_7d_avg", half_even(F.avg("bmi").over(trailing_days(7)), 1))


def ring_closed(kind: str) -> Column:
    """1 when a ring met a positive goal, else 0."""
    value, goal = F.col(kind), F.col(f"{kind}_goal")
    return F.when((value >= goal) & (goal > 0), 1).otherwise(0)


RINGS = ("active_energy_burned", "apple_exercise_time", "apple_stand_hours")


def rings_closed() -> Column:
    return sum((ring_closed(r) for r in RINGS[1:]), ring_closed(RINGS[0])).cast("bigint")


def activity_calendar(t: Tables, s: date, e: date) -> DataFrame:
    """Every day of the range per subject with 0-3 closed rings; details NULL on days without data."""
    days = t.subjects.select("subject_id", F.explode(day_spine(s, e)).alias("date"))
    rings = t.activity.where(between_days(F.col("date_components"), s, e)).select(
        "subject_id",
        F.col("date_components").alias("date"),
        rings_closed().alias("rings"),
        to_long(sql_round(F.col("active_energy_burned"))).alias("move_cal"),
        to_long(sql_round(F.col("apple_exercise_time"))).alias("exercise_min"),
        to_long(F.col("apple_stand_hours")).alias("stand_hrs"),
    )
    return days.join(rings, ["subject_id", "date"], "left").withColumn(
        "rings", F.coalesce("rings", F.lit(0).cast("bigint"))
    )


def week_review(t: Tables, e: date) -> DataFrame:
    """The seven days up to ``e``: was there a workout, and how many rings closed."""
    s = e - timedelta(days=6)
    days = t.subjects.select("subject_id", F.explode(day_spine(s, e)).alias("date"))
    workouts = (
        workouts_between(t, s, e)
        .select("subject_id", day(F.col("start_date")).alias("date"))
        .distinct()
        .withColumn("had_workout", F.lit(True))
    )
    rings = t.activity.where(between_days(F.col("date_components"), s, e)).select(
        "subject_id", F.col("date_components").alias("date"), rings_closed().alias("rings_closed")
    )
    return (
        days.join(workouts, ["subject_id", "date"], "left")
        .join(rings, ["subject_id", "date"], "left")
        .select(
            "subject_id",
            "date",
            day_name(day_of_week(F.col("date"))).alias("day"),
            F.coalesce("had_workout", F.lit(False)).alias("had_workout"),
            F.coalesce("rings_closed", F.lit(0).cast("bigint")).alias("rings_closed"),
        )
    )


def max_heart_rate(t: Tables, e: date) -> DataFrame:
    """Maximum heart rate per subject: from age, else from date of birth at ``e``, else the default.

    An age that is present but unreadable gives the default, without falling back to the date of birth.
    """
    wide = t.subjects.join(profile_wide(t.profile), "subject_id", "left")
    age, born = F.col("age"), F.col("date_of_birth")
    whole_number = F.when(F.trim(age).rlike(r"^[+-]?\d+$"), F.trim(age).try_cast("bigint"))
    iso_day = F.when(born.rlike(r"^\d{4}-\d{2}-\d{2}$"), born.try_cast("date"))
    has_age = F.length(age) > 0
    from_birth = 220 - F.floor(F.datediff(date_lit(e), iso_day) / 365)
    rate = F.when(has_age, 220 - whole_number).otherwise(from_birth)
    return wide.select(
        "subject_id",
        F.coalesce(rate, F.lit(DEFAULT_MAX_HR)).cast("bigint").alias("max_hr"),
    )


def heart_rate_zones(t: Tables, s: date, e: date, max_hr: int | None = None) -> DataFrame:
    """Minutes per week and zone; a sample counts its own length, one minute at least.

    ``max_hr`` fixes one maximum for all; by default each subject's own maximum applies. Samples are folded per
    (subject, week, rate) before the maximum is joined, so the raw table is never joined.
    """
    # Whole seconds add up exactly in any order; they become minutes only at the end.
    seconds = F.greatest(elapsed_seconds(F.col("start_date"), F.col("end_date")), F.lit(60.0))
    folded = (
        records_between(t, s, e, "HeartRate")
        .groupBy("subject_id", week_start(day(F.col("start_date"))).alias("week"), "value")
        .agg(F.sum(seconds).alias("seconds"))
    )
    if max_hr is None:
        folded = folded.join(max_heart_rate(t, e), "subject_id", "left")
        top = F.coalesce(F.col("max_hr"), F.lit(DEFAULT_MAX_HR))
    else:
        top = F.lit(max_hr)
    bounds = [top * F.lit(share) for share in ZONE_BOUNDS]
    rate = F.col("value")
    zones = {
        "rest": rate < bounds[0],
        "fat_burn": (rate >= bounds[0]) & (rate < bounds[1]),
        "cardio": (rate >= bounds[1]) & (rate < bounds[2]),
        "peak": (rate >= bounds[2]) & (rate < bounds[3]),
        "max_zone": rate >= bounds[3],
    }
    return folded.groupBy("subject_id", "week").agg(
        *[to_long(F.sum(F.when(cond, F.col("seconds")).otherwise(0.0)) / 60).alias(name) for name, cond in zones.items()]
    )
