"""Workout analytics: counts, weekly volume, pace, distance, mechanics, streaks and consistency."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.calendar import day, day_of_week, ts_lit, week_start
from pulselake.functions.numeric import half_even, nonzero, sql_round, to_long
from pulselake.operators.daily import workouts_between
from pulselake.operators.intervals import records_within
from pulselake.operators.views import when_type
from pulselake.tables import Tables

# Metres per second to miles per hour, and the workout types forming the strength group.
MPH_PER_MS = 2.23694
STRENGTH_TYPES = ("HIIT", "FunctionalStrengthTraining", "CoreTraining", "TraditionalStrengthTraining")
TOP_TYPES = 6
MIN_SESSION_MINUTES = 5
MARATHON_MILES = 26.0
HALF_MARATHON_MILES = 13.0


def is_kind(kind: str) -> Column:
    """Type names keep their export prefix, so a kind is matched anywhere in the name."""
    return F.col("workout_activity_type").contains(kind)


def is_strength() -> Column:
    cond = is_kind(STRENGTH_TYPES[0])
    for kind in STRENGTH_TYPES[1:]:
        cond |= is_kind(kind)
    return cond


def starting_from(records: DataFrame, s: date) -> DataFrame:
    """Records that can fall into a workout starting on or after ``s``: prunes the scan, changes no result."""
    return records.where(F.col("start_date") >= ts_lit(s))


def type_counts(t: Tables, s: date, e: date) -> DataFrame:
    return (
        workouts_between(t, s, e)
        .groupBy("subject_id", F.col("workout_activity_type").alias("type"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def _weekly_by_type(t: Tables, s: date, e: date, measure: str) -> DataFrame:
    """Per week and type, types beyond a subject's six most frequent folded into 'Other'.

    Workouts are first folded to (subject, week, type) counts; ranking and relabelling work on those.
    Equal counts rank by type name.
    """
    weekly = (
        workouts_between(t, s, e)
        .groupBy(
            "subject_id",
            week_start(day(F.col("start_date"))).alias("week"),
            F.col("workout_activity_type").alias("type"),
        )
        .agg(F.count(F.lit(1)).alias("count"), F.sum("duration").alias("minutes"))
    )
    by_count = Window.partitionBy("subject_id").orderBy(F.desc("n"), F.asc_nulls_last("type"))
    top = (
        weekly.groupBy("subject_id", "type")
        .agg(F.sum("count").alias("n"))
        .withColumn("rank", F.row_number().over(by_count))
        .where(F.col("rank") <= TOP_TYPES)
        .select("subject_id", "type", F.lit(True).alias("is_top"))
    )
    label = F.when(F.col("is_top"), F.col("type")).otherwise("Other")
    labelled = weekly.join(top, ["subject_id", "type"], "left").groupBy("subject_id", "week", label.alias("type"))
    if measure == "count":
        return labelled.agg(F.sum("count").alias("count"))
    return labelled.agg(to_long(sql_round(F.sum("minutes"))).alias("minutes"))


def weekly_counts(t: Tables, s: date, e: date) -> DataFrame:
    return _weekly_by_type(t, s, e, "count")


def weekly_minutes(t: Tables, s: date, e: date) -> DataFrame:
    return _weekly_by_type(t, s, e, "minutes")


def workout_heatmap(t: Tables, s: date, e: date) -> DataFrame:
    return (
        workouts_between(t, s, e)
        .groupBy("subject_id", day(F.col("start_date")).alias("date"))
        .agg(sql_round(F.sum("duration")).alias("total_min"))
        .select("subject_id", "date", day_of_week(F.col("date")).alias("dow"), "total_min")
    )


def running_pace(t: Tables, s: date, e: date) -> DataFrame:
    """Average speed and pace per run from the speed samples wholly inside it; NULL without samples."""
    keys = ["subject_id", "start_date", "duration", "total_distance", "total_distance_unit"]
    runs = workouts_between(t, s, e).where(is_kind("Running") & (F.col("duration") > MIN_SESSION_MINUTES))
    pairs = records_within(
        runs.select(*keys, "end_date"), starting_from(t.of_type("RunningSpeed"), s), both_ends=True
    )
    rows = pairs.select(*keys, "value").unionByName(runs.select(*keys), allowMissingColumns=True)
    per_run = rows.groupBy(*keys).agg(sql_round(F.avg("value"), 2).alias("ms"))
    mph = half_even(nonzero(F.col("ms")) * MPH_PER_MS, 2)
    return per_run.withColumn("avg_speed_mph", mph).select(
        "subject_id",
        day(F.col("start_date")).alias("date"),
        sql_round(F.col("duration"), 1).alias("duration_min"),
        sql_round(F.col("total_distance"), 2).alias("distance"),
        "avg_speed_mph",
        F.when(F.col("avg_speed_mph") > 0, half_even(F.try_divide(F.lit(60.0), F.col("avg_speed_mph")), 2)).alias(
            "pace_min_per_mi"
        ),
    )


def running_distance(t: Tables, s: date, e: date) -> DataFrame:
    """Summed distance samples per run; runs without samples are absent."""
    keys = ["subject_id", "start_date", "duration"]
    runs = workouts_between(t, s, e).where(is_kind("Running") & (F.col("duration") > MIN_SESSION_MINUTES))
    pairs = records_within(
        runs.select(*keys, "end_date"), starting_from(t.of_type("DistanceWalkingRunning"), s), both_ends=True
    )
    per_run = pairs.groupBy(*keys).agg(sql_round(F.sum("value"), 2).alias("distance"))
    return per_run.select(
        "subject_id",
        day(F.col("start_date")).alias("date"),
        "distance",
        sql_round(F.col("duration"), 1).alias("duration_min"),
    )


def cycling_sessions(t: Tables, s: date, e: date) -> DataFrame:
    """Rides with distance and energy of the records inside them, both from one interval join.

    Rides starting at the same instant share one total, and each shows it.
    """
    rides = workouts_between(t, s, e).where(is_kind("Cycling"))
    pairs = records_within(
        rides.select("subject_id", "start_date", "end_date"),
        starting_from(t.of_type("DistanceCycling", "ActiveEnergyBurned"), s),
        both_ends=True,
    )
    totals = pairs.groupBy("subject_id", "start_date").agg(
        sql_round(F.sum(when_type("DistanceCycling")), 2).alias("distance"),
        sql_round(F.sum(when_type("ActiveEnergyBurned"))).alias("calories"),
    )
    shown = rides.where(F.col("duration") > MIN_SESSION_MINUTES).select("subject_id", "start_date", "duration")
    return shown.join(totals, ["subject_id", "start_date"], "left").select(
        "subject_id",
        day(F.col("start_date")).alias("date"),
        "distance",
        sql_round(F.col("duration"), 1).alias("duration_min"),
        "calories",
    )


def running_mechanics(t: Tables, s: date, e: date) -> DataFrame:
    """Daily running form from samples starting inside a run. ``speed`` stays in the stored unit."""
    runs = workouts_between(t, s, e).where(is_kind("Running") & (F.col("duration") > MIN_SESSION_MINUTES))
    records = t.of_type("RunningPower", "RunningGroundContactTime", "RunningVerticalOscillation", "RunningSpeed")
    pairs = records_within(
        runs.select("subject_id", "start_date", "end_date"), starting_from(records, s), both_ends=False
    )
    return pairs.groupBy("subject_id", day(F.col("start_date")).alias("date")).agg(
        sql_round(F.avg(when_type("RunningPower")), 1).alias("power"),
        sql_round(F.avg(when_type("RunningGroundContactTime")), 1).alias("gct"),
        sql_round(F.avg(when_type("RunningVerticalOscillation")), 2).alias("osc"),
        sql_round(F.avg(when_type("RunningSpeed")), 2).alias("speed"),
    )


def workout_days(workouts: DataFrame) -> DataFrame:
    """Distinct workout days: the bounded input of every streak and gap calculation."""
    return workouts.select("subject_id", day(F.col("start_date")).alias("date")).distinct()


def _streaks(days: DataFrame) -> DataFrame:
    """Runs of consecutive days: a day minus its rank is constant within a run."""
    rank = F.row_number().over(Window.partitionBy("subject_id").orderBy("date"))
    return (
        days.where(F.col("date").isNotNull())
        .withColumn("run", F.date_sub("date", rank))
        .groupBy("subject_id", "run")
        .agg(F.count(F.lit(1)).alias("length"), F.max("date").alias("last_day"))
    )


def best_streaks(t: Tables, s: date, e: date) -> DataFrame:
    """The longest streak of each subject with a workout."""
    runs = _streaks(workout_days(workouts_between(t, s, e)))
    return runs.groupBy("subject_id").agg(F.max("length").alias("workout_streak"))


def longest_streak(t: Tables, s: date, e: date) -> DataFrame:
    return t.subjects.join(best_streaks(t, s, e), "subject_id", "left").select(
        "subject_id", F.coalesce("workout_streak", F.lit(0).cast("bigint")).alias("workout_streak")
    )


def current_streak(t: Tables, e: date, compat: bool = True) -> DataFrame:
    """Length of the workout streak ending on the latest workout day up to ``e``.

    The original numbers days downwards while subtracting the number, so its runs never grow beyond one day;
    ``compat=True`` keeps that result (1 with any workout, else 0), ``compat=False`` gives the real streak.
    """
    days = workout_days(t.workouts.where(F.col("start_date") < ts_lit(e + timedelta(days=1))))
    if compat:
        found = days.groupBy("subject_id").agg(F.lit(1).cast("bigint").alias("streak"))
    else:
        found = _streaks(days).groupBy("subject_id").agg(F.max_by("length", "last_day").alias("streak"))
    return t.subjects.join(found, "subject_id", "left").select(
        "subject_id", F.coalesce("streak", F.lit(0).cast("bigint")).alias("current_streak")
    )


def weekly_consistency(t: Tables, s: date, e: date) -> DataFrame:
    """Share of weeks with workouts that had three or more; NULL without any week."""
    weeks = (
        workouts_between(t, s, e)
        .groupBy("subject_id", week_start(day(F.col("start_date"))).alias("week"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("subject_id")
        .agg(half_even(F.count_if(F.col("n") >= 3) / F.count(F.lit(1)) * 100, 1).alias("consistency_pct"))
    )
    return t.subjects.join(weeks, "subject_id", "left").select("subject_id", "consistency_pct")


def longest_rest_gap(t: Tables, s: date, e: date) -> DataFrame:
    previous = F.lag("date").over(Window.partitionBy("subject_id").orderBy("date"))
    gaps = (
        workout_days(workouts_between(t, s, e))
        .withColumn("gap", F.datediff("date", previous))
        .groupBy("subject_id")
        .agg(F.max("gap").alias("gap"))
    )
    return t.subjects.join(gaps, "subject_id", "left").select(
        "subject_id", F.coalesce("gap", F.lit(0)).cast("double").alias("longest_rest_gap")
    )


def consistency(t: Tables, s: date, e: date, compat: bool = True) -> DataFrame:
    return (
        current_streak(t, e, compat)
        .join(weekly_consistency(t, s, e), "subject_id")
        .join(longest_rest_gap(t, s, e), "subject_id")
    )


def distances_by_session(t: Tables, s: date, e: date) -> DataFrame:
    """Per subject and workout start: miles run, walked and ridden, and running power, from one interval join.

    A record belongs to a session when it starts inside it. Sums stay NULL where a session has no such record,
    and sessions of different kinds starting together stay apart by the conditions.
    """
    kinds = is_kind("Running") | is_kind("Walking") | is_kind("Cycling")
    sessions = (
        workouts_between(t, s, e)
        .where(kinds)
        .select(
            "subject_id",
            "start_date",
            "end_date",
            is_kind("Running").alias("run"),
            is_kind("Walking").alias("walk"),
            is_kind("Cycling").alias("ride"),
        )
    )
    records = t.of_type("DistanceWalkingRunning", "DistanceCycling", "RunningPower")
    pairs = records_within(sessions, starting_from(records, s), both_ends=False)
    foot, wheel, power = when_type("DistanceWalkingRunning"), when_type("DistanceCycling"), when_type("RunningPower")
    return pairs.groupBy("subject_id", "start_date").agg(
        F.sum(F.when(F.col("run"), foot)).alias("run_mi"),
        F.sum(F.when(F.col("walk"), foot)).alias("walk_mi"),
        F.sum(F.when(F.col("ride"), wheel)).alias("ride_mi"),
        F.sum(F.when(F.col("run"), power)).alias("power_sum"),
        F.count(F.when(F.col("run"), power)).alias("power_n"),
    )


def distance_totals(sessions: DataFrame) -> DataFrame:
    """Per subject: race counts, longest and total distances and mean running power of ``distances_by_session``."""
    miles = F.col("run_mi")
    zero = F.lit(0.0)
    return sessions.groupBy("subject_id").agg(
        F.count_if(miles >= MARATHON_MILES).alias("marathons"),
        F.count_if((miles >= HALF_MARATHON_MILES) & (miles < MARATHON_MILES)).alias("half_marathons"),
        sql_round(F.coalesce(F.max(miles), zero), 1).alias("longest_run_mi"),
        to_long(sql_round(F.coalesce(F.sum(miles), zero))).alias("total_run_mi"),
        sql_round(F.coalesce(F.max("walk_mi"), zero), 1).alias("longest_walk_mi"),
        to_long(sql_round(F.coalesce(F.sum("ride_mi"), zero))).alias("total_cycling_mi"),
        sql_round(F.coalesce(F.max("ride_mi"), zero), 1).alias("longest_ride_mi"),
        to_long(sql_round(F.try_divide(F.sum("power_sum"), F.sum("power_n")))).alias("avg_run_power"),
    )


def distance_bands(t: Tables, s: date, e: date) -> DataFrame:
    totals = distance_totals(distances_by_session(t, s, e))
    counts = ["marathons", "half_marathons", "total_run_mi"]
    shown = t.subjects.join(totals, "subject_id", "left")
    return shown.select(
        "subject_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("longest_run_mi", F.lit(0.0)).alias("longest_run_mi"),
    )


def walk_and_ride_totals(t: Tables, s: date, e: date) -> DataFrame:
    totals = distance_totals(distances_by_session(t, s, e))
    rides = (
        workouts_between(t, s, e).where(is_kind("Cycling")).groupBy("subject_id").agg(F.count(F.lit(1)).alias("rides"))
    )
    shown = t.subjects.join(totals, "subject_id", "left").join(rides, "subject_id", "left")
    return shown.select(
        "subject_id",
        F.coalesce("longest_walk_mi", F.lit(0.0)).alias("longest_walk_mi"),
        F.coalesce("total_cycling_mi", F.lit(0).cast("bigint")).alias("total_cycling_mi"),
        F.coalesce("longest_ride_mi", F.lit(0.0)).alias("longest_ride_mi"),
        F.coalesce("rides", F.lit(0).cast("bigint")).alias("cycling_count"),
    )
