"""Summary cards, sparklines and personal records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.calendar import between_days, day, week_start
from pulselake.functions.numeric import half_even, nonzero, sql_round, to_long
from pulselake.operators.daily import (
    RINGS,
    as_percent,
    heart_rate_series,
    hrv_series,
    records_between,
    ring_closed,
    rings_series,
    steps_series,
    vo2max_series,
    workouts_between,
)
from pulselake.operators.routes import TYPE_PREFIX
from pulselake.operators.sleep import (
    app_nights_between,
    efficiency_series,
    latency_series,
    score_series,
    sleep_series,
    snore_series,
    stage_total,
)
from pulselake.operators.views import by_day, nights_between, when_type
from pulselake.operators.workouts import (
    best_streaks,
    cycling_sessions,
    distance_totals,
    distances_by_session,
    is_kind,
    is_strength,
    running_distance,
    weekly_counts,
    weekly_minutes,
)
from pulselake.tables import Tables

# Fixed value: kilometres to miles for workout distances.
MI_PER_KM = 0.621371
SPARK_POINTS = 30


def _record_cards(t: Tables, s: date, e: date) -> DataFrame:
    """All cards read from records: one scan, folded to days, then to subjects."""
    averaged = {
        "hrv": when_type("HeartRateVariabilitySDNN"),
        "walk": when_type("WalkingSpeed"),
        "spo2": F.when(F.col("record_type") == "OxygenSaturation", as_percent(F.col("value"))),
        "resp": when_type("RespiratoryRate"),
    }
    vo2 = F.col("record_type") == "VO2Max"
    daily = by_day(
        records_between(
            t,
            s,
            e,
            "StepCount",
            "RestingHeartRate",
            "VO2Max",
            "HeartRateVariabilitySDNN",
            "FlightsClimbed",
            "WalkingSpeed",
            "OxygenSaturation",
            "RespiratoryRate",
            "DistanceWalkingRunning",
        ),
        to_long(F.sum(when_type("StepCount"))).alias("steps"),
        sql_round(F.avg(when_type("RestingHeartRate")), 1).alias("resting_hr"),
        F.sum(when_type("DistanceWalkingRunning")).alias("distance"),
        F.sum(when_type("FlightsClimbed")).alias("flights"),
        F.max(F.when(vo2, F.struct("start_date", "value"))).alias("vo2_last"),
        F.max(when_type("VO2Max")).alias("vo2_max"),
        *[F.sum(c).alias(f"{n}_sum") for n, c in averaged.items()],
        *[F.count(c).alias(f"{n}_n") for n, c in averaged.items()],
    )

    def mean(name: str) -> Column:
        return F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n"))

    return daily.groupBy("subject_id").agg(
        to_long(sql_round(F.avg("steps"))).alias("avg_steps"),
        sql_round(F.avg("resting_hr"), 1).alias("avg_resting_hr"),
        sql_round(F.max("vo2_last")["value"], 1).alias("vo2max_latest"),
        sql_round(F.max("vo2_max"), 1).alias("vo2max_peak"),
        to_long(sql_round(mean("hrv"))).alias("avg_hrv"),
        to_long(sql_round(F.sum("flights"))).alias("total_flights"),
        sql_round(mean("walk"), 1).alias("avg_walking_speed"),
        sql_round(mean("spo2"), 1).alias("avg_spo2"),
        sql_round(mean("resp"), 1).alias("avg_resp_rate"),
        sql_round(F.avg("distance"), 1).alias("avg_daily_distance"),
    )


def _workout_cards(t: Tables, s: date, e: date) -> DataFrame:
    run, ride, strength = is_kind("Running"), is_kind("Cycling"), is_strength()
    minutes, energy = F.col("duration"), F.col("total_energy_burned")
    # Days first, so counting active days needs no distinct aggregate.
    daily = (
        workouts_between(t, s, e)
        .groupBy("subject_id", day(F.col("start_date")).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(minutes).alias("min_sum"),
            F.count(minutes).alias("min_n"),
            F.sum(energy).alias("kcal"),
            F.count_if(run).alias("runs"),
            F.sum(F.when(run, minutes)).alias("run_min"),
            F.count(F.when(run, minutes)).alias("run_min_n"),
            F.count_if(ride).alias("rides"),
            F.count_if(strength).alias("str_n"),
            F.sum(F.when(strength, minutes)).alias("str_min"),
            F.count(F.when(strength, minutes)).alias("str_min_n"),
            F.sum(F.when(strength, energy)).alias("str_kcal"),
        )
    )
    return daily.groupBy("subject_id").agg(
        F.sum("n").alias("workouts"),
        F.count(F.lit(1)).alias("active_days"),
        to_long(sql_round(F.sum("min_sum") / 60.0)).alias("total_workout_hrs"),
        to_long(sql_round(F.try_divide(F.sum("min_sum"), F.sum("min_n")))).alias("avg_workout_dur"),
        to_long(sql_round(F.sum("kcal"))).alias("total_calories"),
        F.sum("runs").alias("run_count"),
        to_long(sql_round(F.try_divide(F.sum("run_min"), F.sum("run_min_n")))).alias("avg_run_dur"),
        F.sum("rides").alias("cycling_count"),
        F.sum("str_n").alias("strength_count"),
        to_long(sql_round(F.sum("str_min"))).alias("strength_total_min"),
        to_long(sql_round(F.try_divide(F.sum("str_min"), F.sum("str_min_n")))).alias("strength_avg_min"),
        to_long(sql_round(F.sum("str_kcal"))).alias("strength_total_cal"),
    )


def _night_cards(t: Tables, s: date, e: date) -> DataFrame:
    return (
        nights_between(t, s, e)
        .groupBy("subject_id")
        .agg(sql_round(F.avg("duration_seconds") / 3600.0, 1).alias("avg_sleep_hours"))
    )


def _stage_cards(t: Tables, s: date, e: date) -> DataFrame:
    nights = app_nights_between(t, s, e).where(stage_total() > 0)
    return nights.groupBy("subject_id").agg(
        sql_round(F.avg("deep_seconds") / 3600.0, 1).alias("avg_deep_sleep"),
        sql_round(F.avg("dream_seconds") / 3600.0, 1).alias("avg_rem_sleep"),
        to_long(sql_round(F.max("sleep_quality") * 100)).alias("best_sleep_quality"),
    )


def _ring_cards(t: Tables, s: date, e: date) -> DataFrame:
    days = t.activity.where(between_days(F.col("date_components"), s, e))
    closed = F.sum(F.least(*[ring_closed(r) for r in RINGS]))
    return days.groupBy("subject_id").agg(
        sql_round(closed * 100.0 / F.count(F.lit(1)), 1).alias("ring_close_pct")
    )


# Shown as 0, not NULL, for a subject without data.
_ZERO_LONG = (
    "avg_steps",
    "workouts",
    "marathons",
    "half_marathons",
    "total_run_mi",
    "workout_streak",
    "active_days",
    "cycling_count",
    "total_cycling_mi",
    "total_workout_hrs",
    "total_flights",
    "run_count",
    "total_calories",
    "strength_count",
    "strength_total_min",
    "strength_avg_min",
    "strength_total_cal",
)
_ZERO_DOUBLE = ("longest_run_mi", "longest_walk_mi", "longest_ride_mi")

SUMMARY_COLUMNS = [
    "avg_steps",
    "avg_resting_hr",
    "workouts",
    "avg_sleep_hours",
    "ring_close_pct",
    "marathons",
    "half_marathons",
    "longest_run_mi",
    "total_run_mi",
    "longest_walk_mi",
    "workout_streak",
    "active_days",
    "cycling_count",
    "total_cycling_mi",
    "longest_ride_mi",
    "total_workout_hrs",
    "vo2max_latest",
    "vo2max_peak",
    "avg_hrv",
    "total_flights",
    "avg_walking_speed",
    "avg_deep_sleep",
    "avg_rem_sleep",
    "best_sleep_quality",
    "avg_run_power",
    "run_count",
    "avg_run_dur",
    "total_calories",
    "avg_workout_dur",
    "avg_spo2",
    "avg_resp_rate",
    "avg_daily_distance",
    "strength_count",
    "strength_total_min",
    "strength_avg_min",
    "strength_total_cal",
]


def summary_cards(t: Tables, s: date, e: date) -> DataFrame:
    """The 36 summary values, one row per subject: a few fused scans instead of one query per value."""
    parts = [
        _record_cards(t, s, e),
        _workout_cards(t, s, e),
        _night_cards(t, s, e),
        _stage_cards(t, s, e),
        _ring_cards(t, s, e),
        distance_totals(distances_by_session(t, s, e)),
        best_streaks(t, s, e),
    ]
    row = t.subjects.select("subject_id")
    for part in parts:
        row = row.join(part, "subject_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in _ZERO_LONG}
    zeros |= {c: F.coalesce(c, F.lit(0.0)) for c in _ZERO_DOUBLE}
    return row.withColumns(zeros).select("subject_id", *SUMMARY_COLUMNS)


def headline_cards(t: Tables, s: date, e: date) -> DataFrame:
    """Steps, resting heart rate, workout count and sleep average of the summary."""
    row = t.subjects.select("subject_id")
    for part in (
        _record_cards(t, s, e).select("subject_id", "avg_steps", "avg_resting_hr"),
        _workout_cards(t, s, e).select("subject_id", "workouts"),
        _night_cards(t, s, e),
    ):
        row = row.join(part, "subject_id", "left")
    zero = F.lit(0).cast("bigint")
    return row.withColumns({c: F.coalesce(c, zero) for c in ("avg_steps", "workouts")}).select(
        "subject_id", "avg_steps", "avg_resting_hr", "workouts", "avg_sleep_hours"
    )


def _best(df: DataFrame, rank: Column, *shown: Column) -> DataFrame:
    """Per subject the row with the smallest rank (negate for the largest); ties go to the smaller ``shown``.

    An aggregation, not a window: it combines map-side, so no subject's rows meet in one task.
    """
    best = F.min(F.struct(rank.alias("rank"), *shown)).alias("best")
    return df.where(rank.isNotNull()).groupBy("subject_id").agg(best).select("subject_id", "best.*")


def _entry(df: DataFrame, label: str, value: Column, when: Column) -> DataFrame:
    return df.select("subject_id", F.lit(label).alias("label"), value.alias("value"), when.alias("date"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _miles() -> Column:
    km = F.col("total_distance_unit") == "km"
    return F.when(km, F.col("total_distance") * MI_PER_KM).otherwise(F.col("total_distance"))


def _thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def _text(x: Column) -> Column:
    return x.cast("string")


def _longest_session(t: Tables, s: date, e: date, kind: str) -> DataFrame:
    sessions = workouts_between(t, s, e).where(is_kind(kind)).withColumn("miles", _miles())
    best = _best(sessions, -F.col("miles"), day(F.col("start_date")).alias("date"))
    return best.withColumn("miles", sql_round(-F.col("rank"), 1))


def personal_records(t: Tables, s: date, e: date) -> DataFrame:
    """Best day or session per category as (label, value text, date); a category without data has no row.

    The four record categories share one scan folded to days; the day's date breaks ties (earliest first).
    """
    daily = by_day(
        records_between(t, s, e, "StepCount", "RestingHeartRate", "VO2Max", "FlightsClimbed"),
        to_long(F.sum(when_type("StepCount"))).alias("steps"),
        sql_round(F.avg(when_type("RestingHeartRate")), 1).alias("resting_hr"),
        F.max(when_type("VO2Max")).alias("vo2"),
        to_long(F.sum(when_type("FlightsClimbed"))).alias("flights"),
    )
    # NULL ranks lose against any value: struct comparison puts NULL first, so they are left out by the condition.
    bests = daily.groupBy("subject_id").agg(
        *[
            F.min(F.when(F.col(c).isNotNull(), F.struct((F.col(c) * sign).alias("rank"), "date"))).alias(c)
            for c, sign in (("steps", -1), ("resting_hr", 1), ("vo2", -1), ("flights", -1))
        ]
    )
    rows = F.array(
        F.struct(
            F.lit("Most Steps").alias("label"),
            _thousands(-F.col("steps.rank")).alias("value"),
            F.col("steps.date").alias("date"),
        ),
        F.struct(
            F.lit("Lowest Resting HR").alias("label"),
            F.concat(_text(F.col("resting_hr.rank")), F.lit(" bpm")).alias("value"),
            F.col("resting_hr.date").alias("date"),
        ),
        F.struct(
            F.lit("Peak VO2Max").alias("label"),
            _text(sql_round(-F.col("vo2.rank"), 1)).alias("value"),
            F.col("vo2.date").alias("date"),
        ),
        F.struct(
            F.lit("Most Flights").alias("label"),
            _thousands(-F.col("flights.rank")).alias("value"),
            F.col("flights.date").alias("date"),
        ),
    )
    from_records = (
        bests.select("subject_id", F.explode(rows).alias("r")).select("subject_id", "r.*").where("value is not null")
    )
    run = _longest_session(t, s, e, "Running")
    quality = _best(app_nights_between(t, s, e), -F.col("sleep_quality"), F.col("date"))
    percent = to_long(sql_round(-F.col("rank") * 100))
    return _union(
        [
            from_records,
            _entry(run, "Longest Run", F.concat(_text(F.col("miles")), F.lit(" mi")), F.col("date")),
            _entry(quality, "Best Sleep Quality", F.concat(_text(percent), F.lit("%")), F.col("date")),
        ]
    )


def training_records(t: Tables, s: date, e: date) -> DataFrame:
    """Training bests as (label, value text, date text); zero values and single-workout weeks give no row."""
    workouts = workouts_between(t, s, e)
    shown = (day(F.col("start_date")).alias("date"), F.col("workout_activity_type").alias("type"))
    kind = F.replace(F.coalesce("type", F.lit("")), F.lit(TYPE_PREFIX), F.lit(""))
    on_day = _text(F.col("date"))

    longest = _best(workouts, -F.col("duration"), *shown).withColumn("v", to_long(sql_round(-F.col("rank"))))
    energy = workouts.where(F.col("total_energy_burned") > 0)
    burned = _best(energy, -F.col("total_energy_burned"), *shown).withColumn("v", to_long(sql_round(-F.col("rank"))))
    run, ride = _longest_session(t, s, e, "Running"), _longest_session(t, s, e, "Cycling")

    sessions = distances_by_session(t, s, e)
    power = F.try_divide(F.col("power_sum"), F.col("power_n"))
    peak = _best(sessions, -power, day(F.col("start_date")).alias("date")).withColumn(
        "v", to_long(sql_round(-F.col("rank")))
    )
    weeks = workouts.groupBy("subject_id", week_start(day(F.col("start_date"))).alias("date")).agg(
        F.count(F.lit(1)).alias("n")
    )
    busiest = _best(weeks, -F.col("n"), F.col("date")).withColumn("v", -F.col("rank"))
    daily = by_day(records_between(t, s, e, "StepCount"), to_long(F.sum("value")).alias("steps"))
    steps = _best(daily, -F.col("steps"), F.col("date")).withColumn("v", -F.col("rank"))

    miles = F.concat(_text(F.col("miles")), F.lit(" mi"))
    positive = F.col("v") != 0
    return _union(
        [
            _entry(
                longest.where(positive),
                "Longest Workout",
                F.concat(_text(F.col("v")), F.lit(" min ("), kind, F.lit(")")),
                on_day,
            ),
            _entry(
                burned.where(positive),
                "Most Calories",
                F.concat(_thousands(F.col("v")), F.lit(" kcal ("), kind, F.lit(")")),
                on_day,
            ),
            _entry(run.where(F.col("miles") != 0), "Longest Run", miles, on_day),
            _entry(ride.where(F.col("miles") != 0), "Longest Ride", miles, on_day),
            _entry(peak.where(positive), "Peak Run Power", F.concat(_text(F.col("v")), F.lit(" W")), on_day),
            _entry(
                busiest.where(F.col("v") > 1),
                "Busiest Week",
                F.concat(_text(F.col("v")), F.lit(" workouts")),
                F.concat(F.lit("Week of "), on_day),
            ),
            _entry(steps.where(positive), "Most Steps (Day)", _thousands(F.col("v")), on_day),
        ]
    )


def sparkline(df: DataFrame, series: str, value: str, order: list[str], points: int = SPARK_POINTS) -> DataFrame:
    """The last ``points`` non-NULL values of a series per subject, oldest first, as (series, place, value).

    Spark limits ranks map-side, so at most ``points`` rows per subject and task are shuffled.
    """
    latest = Window.partitionBy("subject_id").orderBy(*[F.desc(c) for c in order])
    last = (
        df.where(F.col(value).isNotNull())
        .withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= points)
    )
    oldest_first = Window.partitionBy("subject_id").orderBy(F.desc("_back"))
    return last.select(
        "subject_id",
        F.lit(series).alias("series"),
        F.row_number().over(oldest_first).cast("bigint").alias("place"),
        F.col(value).cast("double").alias("value"),
    )


def sparklines(t: Tables, s: date, e: date) -> DataFrame:
    """The sparklines next to the summary cards."""
    scores = score_series(t, s, e)
    return _union(
        [
            sparkline(steps_series(t, s, e), "steps", "steps", ["date"]),
            sparkline(heart_rate_series(t, s, e), "resting_hr", "resting_hr", ["date"]),
            sparkline(sleep_series(t, s, e), "sleep", "hours", ["date", "hours"]),
            sparkline(rings_series(t, s, e), "energy", "energy", ["date", "energy"]),
            sparkline(vo2max_series(t, s, e), "vo2max", "val", ["date"]),
            sparkline(hrv_series(t, s, e), "hrv", "val", ["date"]),
            sparkline(scores, "sleep_score", "score", ["date", "score"]),
            sparkline(weekly_counts(t, s, e), "weekly_workouts", "count", ["week", "type"]),
            sparkline(weekly_minutes(t, s, e), "weekly_minutes", "minutes", ["week", "type"]),
        ]
    )


def series_cards(t: Tables, s: date, e: date) -> DataFrame:
    """Means and totals over the shown series; run and ride values of 0 count as missing."""

    def mean(df: DataFrame, column: Column, digits: int, name: str) -> DataFrame:
        means = df.groupBy("subject_id").agg(F.avg(column).alias("m"))
        return means.select("subject_id", half_even(F.col("m"), digits).alias(name))

    rides = (
        cycling_sessions(t, s, e)
        .groupBy("subject_id")
        .agg(
            F.avg(nonzero(F.col("distance"))).alias("dist"),
            F.avg(nonzero(F.col("duration_min"))).alias("dur"),
            F.sum(nonzero(F.col("calories"))).alias("cal"),
        )
        .select(
            "subject_id",
            half_even(F.col("dist"), 1).alias("avg_ride_dist"),
            half_even(F.col("dur")).alias("avg_ride_dur"),
            half_even(F.col("cal")).alias("total_ride_cal"),
        )
    )
    parts = [
        mean(efficiency_series(t, s, e), F.col("val"), 1, "avg_efficiency"),
        mean(latency_series(t, s, e), F.col("val"), 0, "avg_latency"),
        mean(snore_series(t, s, e), F.col("val"), 0, "avg_snore"),
        mean(score_series(t, s, e), F.col("score"), 0, "avg_sleep_score"),
        mean(running_distance(t, s, e), nonzero(F.col("distance")), 1, "avg_run_dist"),
        rides,
    ]
    row = t.subjects.select("subject_id")
    for part in parts:
        row = row.join(part, "subject_id", "left")
    return row
