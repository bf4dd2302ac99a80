"""Date ranges, period statistics and comparisons with the period before."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.calendar import between_days, date_lit
from pulselake.functions.numeric import ratio, sql_round, to_long
from pulselake.operators.daily import RINGS, records_between, ring_closed, workouts_between
from pulselake.operators.profile import profile_wide
from pulselake.operators.sleep import app_nights_between
from pulselake.operators.views import by_day, nights_between, when_type
from pulselake.tables import Tables

# Fixed names and lengths in days.
NAMED_PERIODS = {
    "last-week": 7,
    "last-month": 30,
    "last-quarter": 90,
    "last-year": 365,
    "all": 3650,
}
TOP_TYPES = 10


def resolve_period(period: str, start: str | None, end: str | None, today: date) -> tuple[date, date]:
    """Start and end of a request: explicit dates, start until today, or a named period. End alone is ignored."""
    if start:
        return date.fromisoformat(start), date.fromisoformat(end) if end else today
    if period not in NAMED_PERIODS:
        raise ValueError(f"{period!r} names no period; known are {', '.join(NAMED_PERIODS)}")
    return today - timedelta(days=NAMED_PERIODS[period]), today


def period_days(s: date, e: date) -> int:
    return (e - s).days or 1


def prior_period(s: date, e: date) -> tuple[date, date]:
    """The days before ``s``: one day shorter than the inclusive period itself, as in the original."""
    return s - timedelta(days=period_days(s, e)), s - timedelta(days=1)


def with_period(df: DataFrame, s: date, e: date) -> DataFrame:
    """Keep rows dated in the period or the one before, tagged ``current`` or ``prior``: one scan serves both."""
    ps, _ = prior_period(s, e)
    return df.where(between_days(F.col("date"), ps, e)).withColumn(
        "period", F.when(F.col("date") >= date_lit(s), "current").otherwise("prior")
    )


def period_windows(t: Tables, s: date, e: date) -> DataFrame:
    """Step days and total per subject for the period and the one before, with the bounds of each."""
    ps, pe = prior_period(s, e)
    daily = by_day(records_between(t, ps, e, "StepCount"), to_long(F.sum("value")).alias("steps"))
    tagged = with_period(daily, s, e)
    current = F.col("period") == "current"
    return (
        tagged.groupBy("subject_id", "period")
        .agg(F.count(F.lit(1)).alias("days"), F.sum("steps").alias("steps"))
        .select(
            "subject_id",
            "period",
            F.when(current, date_lit(s)).otherwise(date_lit(ps)).alias("start"),
            F.when(current, date_lit(e)).otherwise(date_lit(pe)).alias("end"),
            "days",
            "steps",
        )
    )


HEADLINES = ("avg_steps", "avg_resting_hr", "avg_sleep_hours", "avg_hrv")


def headline_metrics(t: Tables, s: date, e: date) -> DataFrame:
    """Average steps, resting heart rate, sleep and HRV of the period and of the one before (``prior_`` columns).

    Both periods come from one scan of the records and one of the nights.
    """
    ps, _ = prior_period(s, e)
    hrv = when_type("HeartRateVariabilitySDNN")
    daily = by_day(
        records_between(t, ps, e, "StepCount", "RestingHeartRate", "HeartRateVariabilitySDNN"),
        to_long(F.sum(when_type("StepCount"))).alias("steps"),
        sql_round(F.avg(when_type("RestingHeartRate")), 1).alias("resting_hr"),
        F.sum(hrv).alias("hrv_sum"),
        F.count(hrv).alias("hrv_n"),
    )
    now = F.col("date") >= date_lit(s)

    def both(prefix_of: dict[str, Column]) -> list[Column]:
        return [c.alias(name) for name, c in prefix_of.items()]

    def steps(cond: Column) -> Column:
        return F.coalesce(to_long(sql_round(F.avg(F.when(cond, F.col("steps"))))), F.lit(0).cast("bigint"))

    def resting(cond: Column) -> Column:
        return sql_round(F.avg(F.when(cond, F.col("resting_hr"))), 1)

    def mean_hrv(cond: Column) -> Column:
        mean = F.try_divide(F.sum(F.when(cond, F.col("hrv_sum"))), F.sum(F.when(cond, F.col("hrv_n"))))
        return to_long(sql_round(mean))

    def sleep(cond: Column) -> Column:
        return sql_round(F.avg(F.when(cond, F.col("duration_seconds"))) / 3600.0, 1)

    measures = daily.groupBy("subject_id").agg(
        *both(
            {
                "avg_steps": steps(now),
                "avg_resting_hr": resting(now),
                "avg_hrv": mean_hrv(now),
                "prior_avg_steps": steps(~now),
                "prior_avg_resting_hr": resting(~now),
                "prior_avg_hrv": mean_hrv(~now),
            }
        )
    )
    nights = (
        nights_between(t, ps, e)
        .groupBy("subject_id")
        .agg(*both({"avg_sleep_hours": sleep(now), "prior_avg_sleep_hours": sleep(~now)}))
    )
    zero = F.lit(0).cast("bigint")
    joined = t.subjects.join(measures, "subject_id", "left").join(nights, "subject_id", "left")
    filled = joined.withColumns({c: F.coalesce(c, zero) for c in ("avg_steps", "prior_avg_steps")})
    return filled.select("subject_id", *HEADLINES, *[f"prior_{m}" for m in HEADLINES])


def prior_period_summary(t: Tables, s: date, e: date) -> DataFrame:
    """The four headline metrics of the period before [s, e]."""
    return headline_metrics(t, s, e).select("subject_id", *[F.col(f"prior_{m}").alias(m) for m in HEADLINES])


def period_deltas(t: Tables, s: date, e: date) -> DataFrame:
    """Change of each headline metric in whole percent, as text, and whether it is good or bad.

    No text without both values, with a prior of 0, or when the change rounds to 0 %. For the resting heart rate
    less is better.
    """
    headlines = headline_metrics(t, s, e)
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(m).cast("double").alias("current"),
                F.col(f"prior_{m}").cast("double").alias("prior"),
                F.lit(m == "avg_resting_hr").alias("less_is_better"),
            )
            for m in HEADLINES
        ]
    )
    long = headlines.select("subject_id", F.explode(rows).alias("m")).select("subject_id", "m.*")
    comparable = F.col("prior") != 0
    diff = F.col("current") - F.col("prior")
    pct = F.rint(F.try_divide(diff, F.abs("prior")) * 100).cast("bigint")
    return long.select(
        "subject_id",
        "metric",
        "current",
        "prior",
        F.when(comparable & (pct != 0), F.format_string("%+d%%", pct)).alias("delta"),
        F.when(
            comparable & (diff != 0),
            F.when((diff > 0) != F.col("less_is_better"), "good").otherwise("bad"),
        ).alias("direction"),
    )


def _zeroed(stats: DataFrame, zeros: tuple[str, ...]) -> DataFrame:
    """0 instead of NULL in the named columns."""
    types = dict(stats.dtypes)
    return stats.withColumns({c: F.coalesce(c, F.lit(0).cast(types[c])) for c in zeros}) if zeros else stats


def _for_all(t: Tables, stats: DataFrame, zeros: tuple[str, ...]) -> DataFrame:
    """Every subject, with 0 instead of NULL in the named columns."""
    return _zeroed(t.subjects.select("subject_id").join(stats, "subject_id", "left"), zeros)


def _step_rows(t: Tables, s: date, e: date) -> DataFrame:
    ps, _ = prior_period(s, e)
    daily = with_period(
        by_day(records_between(t, ps, e, "StepCount"), to_long(F.sum("value")).alias("steps")), s, e
    )
    now = F.when(F.col("period") == "current", F.col("steps"))
    before = F.when(F.col("period") == "prior", F.col("steps"))
    return daily.groupBy("subject_id").agg(
        F.sum(now).alias("total"),
        to_long(sql_round(F.avg(now))).alias("daily_avg"),
        F.min(now).alias("min_day"),
        F.max(now).alias("max_day"),
        to_long(sql_round(F.avg(before))).alias("prior_daily_avg"),
    )


def _heart_rate_rows(t: Tables, s: date, e: date) -> DataFrame:
    ps, _ = prior_period(s, e)
    heart, resting = when_type("HeartRate"), when_type("RestingHeartRate")
    daily = with_period(
        by_day(
            records_between(t, ps, e, "HeartRate", "RestingHeartRate"),
            sql_round(F.avg(heart), 1).alias("avg_hr"),
            sql_round(F.min(heart), 1).alias("min_hr"),
            sql_round(F.max(heart), 1).alias("max_hr"),
            sql_round(F.avg(resting), 1).alias("resting_hr"),
        ),
        s,
        e,
    )

    def of(period: str, column: str) -> Column:
        return F.when(F.col("period") == period, F.col(column))

    return daily.groupBy("subject_id").agg(
        sql_round(F.avg(of("current", "resting_hr")), 1).alias("avg_resting"),
        sql_round(F.min(of("current", "resting_hr")), 1).alias("min_resting"),
        sql_round(F.max(of("current", "resting_hr")), 1).alias("max_resting"),
        sql_round(F.avg(of("current", "avg_hr")), 1).alias("avg_overall"),
        sql_round(F.min(of("current", "min_hr")), 1).alias("min_overall"),
        sql_round(F.max(of("current", "max_hr")), 1).alias("max_overall"),
        sql_round(F.avg(of("prior", "resting_hr")), 1).alias("prior_avg_resting"),
    )


def _sleep_rows(t: Tables, s: date, e: date) -> DataFrame:
    ps, _ = prior_period(s, e)
    nights = with_period(nights_between(t, ps, e), s, e)
    now = F.when(F.col("period") == "current", F.col("duration_seconds"))
    before = F.when(F.col("period") == "prior", F.col("duration_seconds"))
    durations = nights.groupBy("subject_id").agg(
        sql_round(F.avg(now) / 3600.0, 1).alias("avg_hours"),
        sql_round(F.min(now) / 3600.0, 1).alias("min_hours"),
        sql_round(F.max(now) / 3600.0, 1).alias("max_hours"),
        F.count(now).alias("nights_tracked"),
        sql_round(F.avg(before) / 3600.0, 1).alias("prior_avg_hours"),
    )
    quality = F.when(F.col("sleep_quality") > 0, F.col("sleep_quality"))
    stages = (
        app_nights_between(t, s, e)
        .groupBy("subject_id")
        .agg(
            sql_round(F.avg(quality) * 100, 1).alias("avg_quality_pct"),
            *[
                sql_round(F.avg(f"{stage}_seconds") / 60.0).alias(f"avg_{stage}_min")
                for stage in ("deep", "light", "dream", "awake")
            ],
        )
    )
    return durations.join(stages, "subject_id", "full").select(
        "subject_id",
        "avg_hours",
        "min_hours",
        "max_hours",
        "nights_tracked",
        "avg_quality_pct",
        "prior_avg_hours",
        "avg_deep_min",
        "avg_light_min",
        "avg_dream_min",
        "avg_awake_min",
    )


def _workout_rows(t: Tables, s: date, e: date) -> DataFrame:
    return (
        workouts_between(t, s, e)
        .groupBy("subject_id")
        .agg(
            F.count(F.lit(1)).alias("count"),
            sql_round(F.sum("duration")).alias("total_duration_min"),
            sql_round(F.sum("total_distance"), 1).alias("total_distance"),
            sql_round(F.avg("total_energy_burned")).alias("avg_calories"),
        )
    )


def workout_types(t: Tables, s: date, e: date, top: int = TOP_TYPES) -> DataFrame:
    """A subject's most frequent workout types with their rank; equal counts rank by name."""
    per_type = (
        workouts_between(t, s, e)
        .groupBy("subject_id", F.col("workout_activity_type").alias("type"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            sql_round(F.sum("duration")).alias("total_min"),
            sql_round(F.sum("total_distance"), 1).alias("total_dist"),
        )
    )
    order = Window.partitionBy("subject_id").orderBy(F.desc("count"), F.asc_nulls_last("type"))
    return per_type.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)


def _ring_rows(t: Tables, s: date, e: date) -> DataFrame:
    """Days tracked, share of days each ring closed, and days with all three; NULL shares without days."""
    days = t.activity.where(between_days(F.col("date_components"), s, e))
    closed = [ring_closed(r) for r in RINGS]
    return days.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("days_tracked"),
        *[
            sql_round(ratio(F.sum(c) * 100.0, F.count(F.lit(1))), 1).alias(name)
            for c, name in zip(closed, ("move_close_pct", "exercise_close_pct", "stand_close_pct"), strict=True)
        ],
        F.sum(F.least(*closed)).cast("bigint").alias("all_rings_closed_days"),
    )


def _profile_rows(t: Tables, s: date, e: date) -> DataFrame:
    return profile_wide(t.profile)


# Per section: its rows, and the columns showing 0 for a subject without data.
SECTIONS: dict[str, tuple[Callable[[Tables, date, date], DataFrame], tuple[str, ...]]] = {
    "steps": (_step_rows, ("total", "daily_avg", "min_day", "max_day", "prior_daily_avg")),
    "heart_rate": (_heart_rate_rows, ()),
    "sleep": (_sleep_rows, ("nights_tracked",)),
    "workouts": (_workout_rows, ("count", "total_duration_min", "total_distance", "avg_calories")),
    "activity_rings": (_ring_rows, ("days_tracked",)),
    "profile": (_profile_rows, ()),
}


def section_stats(t: Tables, s: date, e: date, section: str) -> DataFrame:
    """One section of the period statistics for every subject."""
    rows, zeros = SECTIONS[section]
    return _for_all(t, rows(t, s, e), zeros)


def step_stats(t: Tables, s: date, e: date) -> DataFrame:
    return section_stats(t, s, e, "steps")


def heart_rate_stats(t: Tables, s: date, e: date) -> DataFrame:
    return section_stats(t, s, e, "heart_rate")


def sleep_stats(t: Tables, s: date, e: date) -> DataFrame:
    return section_stats(t, s, e, "sleep")


def workout_totals(t: Tables, s: date, e: date) -> DataFrame:
    return section_stats(t, s, e, "workouts")


def ring_stats(t: Tables, s: date, e: date) -> DataFrame:
    return section_stats(t, s, e, "activity_rings")


def period_stats(t: Tables, s: date, e: date) -> DataFrame:
    """All period statistics of a subject in one row of structs: the input of the digest."""
    # At most ten short rows per subject by construction of ``workout_types``.
    types = (
        workout_types(t, s, e)
        .groupBy("subject_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "type", "count", "total_min", "total_dist"))).alias("by_type"))
    )
    row = t.subjects.select("subject_id")
    for name, (section_rows, zeros) in SECTIONS.items():
        part = _zeroed(section_rows(t, s, e), zeros)
        fields = [f for f in part.schema if f.name != "subject_id"]
        absent = F.struct(*[F.lit(0 if f.name in zeros else None).cast(f.dataType).alias(f.name) for f in fields])
        packed = part.select("subject_id", F.struct(*[f.name for f in fields]).alias(name))
        row = row.join(packed, "subject_id", "left").withColumn(name, F.coalesce(name, absent))
    period = F.struct(
        date_lit(s).alias("start"), date_lit(e).alias("end"), F.lit(period_days(s, e)).alias("days")
    ).alias("period")
    return row.join(types, "subject_id", "left").select("subject_id", period, *SECTIONS, "by_type")


def monthly_flags(monthly: DataFrame) -> DataFrame:
    """Each month's metrics against the subject's mean over the months: above-avg, below-avg or NULL.

    For the resting heart rate a value below the mean is the good ("above-avg") side.
    """
    over_months = Window.partitionBy("subject_id")

    def flag(metric: str, less_is_better: bool = False) -> Column:
        diff = F.col(metric) - F.avg(metric).over(over_months)
        good = diff < 0 if less_is_better else diff > 0
        bad = diff > 0 if less_is_better else diff < 0
        return F.when(good, "above-avg").when(bad, "below-avg").alias(f"{metric}_flag")

    return monthly.select(
        "subject_id",
        "month",
        flag("avg_daily_steps"),
        flag("avg_sleep_hrs"),
        flag("avg_resting_hr", less_is_better=True),
        flag("avg_vo2max"),
        flag("avg_hrv"),
    )
