"""Sleep analytics: nightly series with trailing means, environment, next-day effects and the sleep score.

Nightly rows are raw rows, so trailing means go through ``trailing_over_rows``. Frames count rows, not calendar
days; nights of the same date are ordered by their times.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.calendar import day, ts_between_days
from pulselake.functions.numeric import ratio, sql_round, to_long
from pulselake.functions.ordered import trailing_over_rows, with_running_total
from pulselake.operators.daily import records_between, workout_minutes_by_day, workouts_between
from pulselake.operators.views import by_day, daily_resting_hr, nights_between, when_type
from pulselake.tables import Tables

STAGES = ("deep_seconds", "light_seconds", "dream_seconds", "awake_seconds")
TREND_ROWS = 7


def app_nights_between(t: Tables, s: date, e: date) -> DataFrame:
    return t.sleep.where(ts_between_days(F.col("start_time"), s, e)).withColumn("date", day(F.col("start_time")))


def stage_total() -> Column:
    """Sum of the four stages; NULL as soon as one is missing."""
    return F.col(STAGES[0]) + F.col(STAGES[1]) + F.col(STAGES[2]) + F.col(STAGES[3])


def sleep_series(t: Tables, s: date, e: date) -> DataFrame:
    return nights_between(t, s, e).select(
        "subject_id",
        "date",
        "source",
        sql_round(F.col("duration_seconds") / 3600.0, 2).alias("hours"),
        F.col("sleep_quality").alias("quality"),
    )


def stages_series(t: Tables, s: date, e: date) -> DataFrame:
    nights = app_nights_between(t, s, e).where(stage_total() > 0)
    shown = {"deep": "deep_seconds", "light": "light_seconds", "rem": "dream_seconds", "awake": "awake_seconds"}
    return nights.select(
        "subject_id", "date", *[sql_round(F.col(c) / 3600.0, 2).alias(name) for name, c in shown.items()]
    )


_NIGHT_ORDER = ("start_time", "end_time", "time_in_bed_seconds", "time_asleep_seconds")


def trailing_mean(nights: DataFrame, metric: str) -> DataFrame:
    """Add ``mean``, the metric's mean over each night and the six before it; equal times fall to the metric."""
    day_number = F.datediff("date", F.lit("1970-01-01").cast("date"))
    order = [F.asc_nulls_last(c) for c in (*_NIGHT_ORDER, metric)]
    return trailing_over_rows(nights, ["subject_id"], day_number, order, TREND_ROWS, {"mean": F.avg(metric)})


def _trend(nights: DataFrame, metric: Column) -> DataFrame:
    measured = nights.select("subject_id", "date", *_NIGHT_ORDER, metric.alias("metric"))
    return trailing_mean(measured, "metric").select(
        "subject_id",
        "date",
        sql_round(F.col("metric"), 1).alias("val"),
        sql_round(F.col("mean"), 1).alias("ma"),
    )


def efficiency_series(t: Tables, s: date, e: date) -> DataFrame:
    nights = app_nights_between(t, s, e).where(F.col("time_in_bed_seconds") > 0)
    return _trend(nights, ratio(F.col("time_asleep_seconds"), F.col("time_in_bed_seconds")) * 100)


def latency_series(t: Tables, s: date, e: date) -> DataFrame:
    nights = app_nights_between(t, s, e).where(F.col("time_before_sleep_seconds") > 0)
    return _trend(nights, F.col("time_before_sleep_seconds") / 60.0)


def snore_series(t: Tables, s: date, e: date) -> DataFrame:
    nights = app_nights_between(t, s, e).where(F.col("snore_time_seconds") > 0)
    return _trend(nights, F.col("snore_time_seconds") / 60.0)


def regularity_series(t: Tables, s: date, e: date) -> DataFrame:
    nights = app_nights_between(t, s, e).where(F.col("regularity") > 0)
    return _trend(nights, F.col("regularity") * 100)


def night_heart_rate(t: Tables, s: date, e: date) -> DataFrame:
    nights = app_nights_between(t, s, e).where(F.col("heart_rate_bpm").isNotNull())
    resting = daily_resting_hr(records_between(t, s, e, "RestingHeartRate"))
    return nights.join(resting, ["subject_id", "date"], "left").select(
        "subject_id", "date", F.col("heart_rate_bpm").alias("sleep_hr"), "resting_hr"
    )


def percentile_bounds(
    df: DataFrame, keys: list[str], metrics: dict[str, str], shares: tuple[float, float]
) -> DataFrame:
    """Exact interpolated percentiles per key, as ``<name>_lo`` and ``<name>_hi`` for each metric.

    Equal values fold to (value, count) before any shuffle, a running count sliced by the whole part of the value
    finds the two neighbours of each percentile. No key's values are gathered in one place.
    """
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("v")) for n, c in metrics.items()])
        ).alias("m"),
    ).select(*keys, "m.metric", "m.v")
    counts = long.groupBy(*keys, "metric", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = with_running_total(counts, [*keys, "metric"], F.floor("v"), [F.asc("v")], weight=F.col("n"))

    def value_at(name: str, index: Column) -> Column:
        here = (F.col("pos") - F.col("n") <= index) & (index < F.col("pos"))
        return F.max(F.when((F.col("metric") == name) & here, F.col("v")))

    aggregates = []
    for name in metrics:
        for suffix, share in zip(("lo", "hi"), shares, strict=True):
            place = (F.col("total") - 1) * F.lit(share)
            aggregates += [
                value_at(name, F.floor(place)).alias(f"_{name}_{suffix}_a"),
                value_at(name, F.ceil(place)).alias(f"_{name}_{suffix}_b"),
                F.max(F.when(F.col("metric") == name, place - F.floor(place))).alias(f"_{name}_{suffix}_f"),
            ]
    found = placed.groupBy(*keys).agg(*aggregates)
    return found.select(
        *keys,
        *[
            (F.col(f"_{p}_a") + (F.col(f"_{p}_b") - F.col(f"_{p}_a")) * F.col(f"_{p}_f")).alias(p)
            for name in metrics
            for p in (f"{name}_lo", f"{name}_hi")
        ],
    )


def sleep_environment(t: Tables, s: date, e: date) -> DataFrame:
    """Nights whose temperature and movement lie within the subject's 5th and 95th percentile.

    A missing reading passes. The bounds use nights with both readings; without such a night every reading fails.
    """
    nights = app_nights_between(t, s, e)
    temp, moves = F.col("weather_temperature_f"), F.col("movements_per_hour")
    bounds = percentile_bounds(
        nights.where(temp.isNotNull() & moves.isNotNull()),
        ["subject_id"],
        {"temp": "weather_temperature_f", "mov": "movements_per_hour"},
        (0.05, 0.95),
    )
    return (
        nights.join(bounds, "subject_id", "left")
        .where(temp.isNull() | temp.between(F.col("temp_lo"), F.col("temp_hi")))
        .where(moves.isNull() | moves.between(F.col("mov_lo"), F.col("mov_hi")))
        .select(
            "subject_id",
            "date",
            temp.alias("temp_f"),
            F.col("air_pressure_pa").alias("pressure"),
            moves.alias("movements"),
            sql_round(F.col("sleep_quality") * 100, 1).alias("quality"),
        )
    )


def sleep_impact(t: Tables, s: date, e: date) -> DataFrame:
    """Each night next to the following day's steps, resting heart rate and workout minutes."""
    key = ["subject_id", "date"]
    first, last = s + timedelta(days=1), e + timedelta(days=1)
    nights = nights_between(t, s, e).select(
        "subject_id", F.date_add("date", 1).alias("date"), "duration_seconds", F.col("sleep_quality").alias("q")
    )
    measures = by_day(
        records_between(t, first, last, "StepCount", "RestingHeartRate"),
        to_long(F.sum(when_type("StepCount"))).alias("steps"),
        sql_round(F.avg(when_type("RestingHeartRate")), 1).alias("resting_hr"),
    ).where(F.col("steps").isNotNull())
    workouts = workout_minutes_by_day(workouts_between(t, first, last))
    return (
        nights.join(measures, key, "inner")
        .join(workouts, key, "left")
        .select(
            *key,
            sql_round(F.col("duration_seconds") / 3600.0, 1).alias("sleep_hrs"),
            sql_round(F.col("q") * 100, 1).alias("sleep_quality"),
            "steps",
            "resting_hr",
            sql_round(F.col("workout_min")).alias("workout_min"),
        )
    )


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def score_expression() -> Column:
    """0-100: duration 40 %, efficiency 25 %, regularity 15 %, time to sleep 10 %, deep sleep 10 %.

    Full duration marks for 7-8 h, losing 25 per hour beyond; 60 minutes awake in bed gives 0 for time to sleep;
    20 % deep sleep gives full marks. A missing part counts 0.
    """
    hours = F.col("time_asleep_seconds") / 3600.0
    duration = (
        F.when(hours < 7, F.greatest(F.lit(0.0), hours / 7 * 100))
        .when(hours > 8, F.greatest(F.lit(0.0), 100 - (hours - 8) * 25))
        .otherwise(100.0)
    )
    efficiency = F.when(
        F.col("time_in_bed_seconds") > 0,
        F.try_divide(F.col("time_asleep_seconds"), F.col("time_in_bed_seconds")) * 100,
    )
    latency = _clamp((60 - F.col("time_before_sleep_seconds") / 60.0) / 50 * 100)
    latency = F.when(F.col("time_before_sleep_seconds").isNotNull(), latency)
    deep_share = F.when(stage_total() > 0, F.try_divide(F.col("deep_seconds"), stage_total()))
    deep = F.when(deep_share.isNotNull(), F.least(F.lit(100.0), (deep_share * 100 / 20) * 100))
    zero = F.lit(0.0)
    total = (
        duration * 0.4
        + F.coalesce(efficiency, zero) * 0.25
        + F.coalesce(F.col("regularity") * 100, zero) * 0.15
        + F.coalesce(latency, zero) * 0.1
        + F.coalesce(deep, zero) * 0.1
    )
    return _clamp(F.rint(total)).cast("bigint")


def score_series(t: Tables, s: date, e: date) -> DataFrame:
    nights = app_nights_between(t, s, e).where(F.col("time_asleep_seconds") > 0)
    scored = nights.select("subject_id", "date", *_NIGHT_ORDER, score_expression().alias("score"))
    return trailing_mean(scored, "score").select(
        "subject_id", "date", "score", to_long(F.col("mean")).alias("score_7d_avg")
    )
