"""Every operator as a named query over the driver's tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.operators import daily, digest, intervals, period, profile, routes, sleep, summary, views, workouts
from pulselake.plans.driver_tables import END, START, derive_tables
from pulselake.sinks.json_rows import dashboard_datasets, json_rows
from pulselake.sinks.store import open_tables, refresh
from pulselake.sources import export_xml, gpx, sleep_csv
from pulselake.sources.load import row_counts, top_record_types
from pulselake.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

# The derived tracks are short, so a small limit makes the sampling visible.
SAMPLE_POINTS = 4
QUESTION = "Am I sleeping enough?"


def shared_folder(spark: SparkSession) -> str:
    """A new folder all executors can reach: below the cluster's checkpoint folder; a temporary one on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root}/pulselake-{uuid4().hex}"


def _text(c: Column) -> Column:
    return c.cast("string")


def _attribute(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f' {name}="'), _text(value), F.lit('"')), F.lit(""))


def _tag(element: str, attributes: dict[str, Column]) -> Column:
    return F.concat(F.lit(element), *[_attribute(n, c) for n, c in attributes.items()], F.lit("/>\n  ")).alias("tag")


def _zoned(ts: Column) -> Column:
    return F.concat(_text(ts), F.lit(" -0700"))


def parsed_records(t: Tables) -> DataFrame:
    """Records written as export tags and read back."""
    c = F.col
    kind = F.when(c("record_type") == "SleepAnalysis", "HKCategoryTypeIdentifier").otherwise("HKQuantityTypeIdentifier")
    tags = t.records.select(
        "subject_id",
        _tag(
            "Record",
            {
                "type": F.concat(kind, c("record_type")),
                "sourceName": F.when(F.col("value") % 2 == 0, "Tom &amp; &quot;Watch&quot; > 1").otherwise("Tom > 1"),
                "startDate": _zoned(c("start_date")),
                "endDate": _zoned(c("end_date")),
                "value": F.coalesce(_text(c("value")), F.lit("HKCategoryValueSleepAnalysisAsleep")),
            },
        ),
    )
    return export_xml.parse_records(tags).select(
        "subject_id", "source_name", "record_type", "start_date", "end_date", "value"
    )


def parsed_workouts(t: Tables) -> DataFrame:
    c = F.col
    tags = t.workouts.select(
        "subject_id",
        _tag(
            "Workout",
            {
                "workoutActivityType": c("workout_activity_type"),
                "startDate": _zoned(c("start_date")),
                "endDate": _zoned(c("end_date")),
                "duration": c("duration"),
                "totalDistance": c("total_distance"),
                "totalDistanceUnit": c("total_distance_unit"),
                "totalEnergyBurned": c("total_energy_burned"),
            },
        ),
    )
    return export_xml.parse_workouts(tags).select(
        "subject_id",
        "workout_activity_type",
        "start_date",
        "end_date",
        "duration",
        "total_distance",
        "total_distance_unit",
        "total_energy_burned",
    )


def parsed_activity(t: Tables) -> DataFrame:
    c = F.col
    tags = t.activity.select(
        "subject_id",
        _tag(
            "ActivitySummary",
            {
                "dateComponents": c("date_components"),
                "activeEnergyBurned": c("active_energy_burned"),
                "activeEnergyBurnedGoal": c("active_energy_burned_goal"),
                "appleExerciseTime": c("apple_exercise_time"),
                "appleStandHours": c("apple_stand_hours"),
            },
        ),
    )
    return export_xml.parse_activity(tags).select(
        "subject_id",
        "date_components",
        "active_energy_burned",
        "active_energy_burned_goal",
        "apple_exercise_time",
        "apple_stand_hours",
    )


def parsed_profile(t: Tables) -> DataFrame:
    sex = F.when(F.col("sex") == "female", "HKBiologicalSexFemale").otherwise("HKBiologicalSexMale")
    tags = profile.profile_wide(t.profile).select(
        "subject_id",
        _tag("Me", {export_xml.BIRTH_ATTRIBUTE: F.col("date_of_birth"), export_xml.SEX_ATTRIBUTE: sex}),
    )
    return export_xml.parse_profile(tags)


def parsed_route_points(t: Tables) -> DataFrame:
    """Each point written as a one-point track with namespaced extensions, and read back."""

    def element(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"<{name}>"), _text(value), F.lit(f"</{name}>")), F.lit(""))

    c = F.col
    instant = F.concat(F.replace(_text(c("recorded_at")), F.lit(" "), F.lit("T")), F.lit("Z"))
    xml = F.concat(
        F.lit("<trk>"),
        element("name", c("workout_name")),
        F.lit("<trkseg><trkpt"),
        _attribute("lat", c("latitude")),
        _attribute("lon", c("longitude")),
        F.lit(">"),
        element("ele", c("elevation")),
        element("time", instant),
        F.lit("<extensions>"),
        element("speed", c("speed")),
        F.lit("</extensions></trkpt></trkseg></trk>"),
    )
    tracks = t.route_points.select("subject_id", "gpx_file", F.from_xml(xml, gpx.TRACK_SCHEMA).alias("trk"))
    points = gpx.flatten_tracks(tracks.select("subject_id", "gpx_file", "trk.*"))
    return points.select("subject_id", "gpx_file", "recorded_at", "latitude", "longitude", "elevation", "speed")


def parsed_nights(t: Tables) -> DataFrame:
    """Nights written as the app's text columns and read back."""

    def raw(name: str, read: Callable) -> Column:
        if read is sleep_csv._percent:
            return F.concat(_text(F.col(name) * 100), F.lit("%"))
        return _text(F.col(name))

    text = t.sleep.select("subject_id", *[raw(n, read).alias(h) for h, n, read in sleep_csv.SLEEP_COLUMNS])
    return sleep_csv.parse_nights(text).select(
        "subject_id",
        "start_time",
        "sleep_quality",
        "regularity",
        "deep_seconds",
        "heart_rate_bpm",
        "weather_temperature_f",
    )


def profile_updates(t: Tables) -> DataFrame:
    """New weights for all, over an outdated one, and a new age for every second subject."""
    subject = F.col("subject_id")
    changes = [
        ("weight_lbs", F.lit("1"), 1),
        ("weight_lbs", _text(subject + 100), 2),
        ("age", F.when(subject % 2 == 0, "50"), 1),
    ]
    rows = F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(n).alias("version")) for k, v, n in changes]
    )
    return t.subjects.select("subject_id", F.explode(rows).alias("u")).select("subject_id", "u.*")


def stored_row_counts(t: Tables) -> DataFrame:
    """Rows per table after storing all tables and opening them again."""
    spark = t.records.sparkSession
    root = shared_folder(spark)
    refresh(t, root)
    return row_counts(open_tables(spark, root))


def _pair_sums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("subject_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum("value").alias("total"))


def _route_workout_pairs(t: Tables) -> DataFrame:
    spans = routes.recent_routes(t, START, END)
    sessions = t.workouts.select("subject_id", "start_date", "end_date", "duration")
    pairs = intervals.overlapping(spans, sessions, ("route_start", "route_end"), ("start_date", "end_date"))
    return pairs.groupBy("subject_id", "gpx_file").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("duration").alias("minutes")
    )


def _stats_row(t: Tables) -> DataFrame:
    return period.period_stats(t, START, END).select(
        "subject_id",
        "steps.daily_avg",
        "steps.prior_daily_avg",
        "heart_rate.avg_resting",
        "sleep.avg_hours",
        "sleep.nights_tracked",
        F.col("workouts.count").alias("workouts"),
        "activity_rings.days_tracked",
        "profile.age",
        F.greatest(F.size("by_type"), F.lit(0)).cast("bigint").alias("types"),
    )


def _json_payload(t: Tables) -> DataFrame:
    shown = ("steps", "heart_rate", "weight", "weekly_workouts", "running_pace")
    return json_rows(dashboard_datasets(t, START, END, shown))


def _ranged(operator: Callable[..., DataFrame], **options) -> Callable[[Tables], DataFrame]:
    return lambda t: operator(t, START, END, **options)


def _track_points(t: Tables) -> DataFrame:
    return routes.ordered_points(t, routes.recent_routes(t, START, END))


def _sampled(t: Tables) -> DataFrame:
    return routes.sampled_points(t, START, END, max_pts=SAMPLE_POINTS)


ON_TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    # Base views
    "view_daily_steps": lambda t: views.daily_steps(t.records),
    "view_daily_heart_rate": lambda t: views.daily_heart_rate(t.records),
    "view_daily_resting_hr": lambda t: views.daily_resting_hr(t.records),
    "view_daily_summary": views.daily_summary,
    "view_workout_summary": views.workout_summary,
    "view_sleep_combined": views.sleep_combined,
    # Daily and calendar
    "steps_series": _ranged(daily.steps_series),
    "heart_rate_series": _ranged(daily.heart_rate_series),
    "rings_series": _ranged(daily.rings_series),
    "weekday_profile": _ranged(daily.weekday_profile),
    "monthly_summary": _ranged(daily.monthly_summary),
    "correlation_rows": _ranged(daily.correlation_rows),
    "daily_minimum_heart_rate": _ranged(daily.daily_record_series, record_type="HeartRate", agg="MIN", ma_window=5),
    "vo2max_series": _ranged(daily.vo2max_series),
    "hrv_series": _ranged(daily.hrv_series),
    "respiratory_series": _ranged(daily.respiratory_series),
    "walking_speed_series": _ranged(daily.walking_speed_series),
    "flights_series": _ranged(daily.flights_series),
    "spo2_series": _ranged(daily.spo2_series),
    "weight_series": _ranged(daily.weight_series),
    "bmi_series": _ranged(daily.bmi_series),
    "activity_calendar": _ranged(daily.activity_calendar),
    "week_review": lambda t: daily.week_review(t, END),
    "heart_rate_zones": _ranged(daily.heart_rate_zones),
    "max_heart_rate": lambda t: daily.max_heart_rate(t, END),
    # Workouts
    "workout_type_counts": _ranged(workouts.type_counts),
    "running_pace": _ranged(workouts.running_pace),
    "running_distance": _ranged(workouts.running_distance),
    "cycling_sessions": _ranged(workouts.cycling_sessions),
    "weekly_workouts": _ranged(workouts.weekly_counts),
    "weekly_minutes": _ranged(workouts.weekly_minutes),
    "workout_heatmap": _ranged(workouts.workout_heatmap),
    "running_mechanics": _ranged(workouts.running_mechanics),
    "longest_streak": _ranged(workouts.longest_streak),
    "current_streak": lambda t: workouts.current_streak(t, END, compat=False),
    "workout_consistency": _ranged(workouts.consistency),
    "distance_bands": _ranged(workouts.distance_bands),
    "walk_and_ride_totals": _ranged(workouts.walk_and_ride_totals),
    # Interval joins
    "interval_join_both_ends": lambda t: _pair_sums(intervals.records_within(t.workouts, t.records, both_ends=True)),
    "interval_join_start_only": lambda t: _pair_sums(intervals.records_within(t.workouts, t.records, both_ends=False)),
    "interval_overlap_join": _route_workout_pairs,
    # Routes
    "workout_routes": _ranged(routes.workout_routes),
    "route_distances": _ranged(routes.route_distance_table),
    "route_points_sampled": _sampled,
    "route_elevation_gain": lambda t: routes.elevation_gain(_track_points(t)),
    "route_elevation_profile": lambda t: routes.elevation_profile(_track_points(t)),
    "route_labels": lambda t: routes.route_labels(routes.workout_routes(t, START, END)),
    # Sleep
    "sleep_series": _ranged(sleep.sleep_series),
    "sleep_stages": _ranged(sleep.stages_series),
    "sleep_efficiency": _ranged(sleep.efficiency_series),
    "sleep_latency": _ranged(sleep.latency_series),
    "snore_series": _ranged(sleep.snore_series),
    "sleep_regularity": _ranged(sleep.regularity_series),
    "night_heart_rate": _ranged(sleep.night_heart_rate),
    "sleep_environment": _ranged(sleep.sleep_environment),
    "sleep_impact": _ranged(sleep.sleep_impact),
    "sleep_score": _ranged(sleep.score_series),
    # Summaries and records
    "summary_cards": _ranged(summary.summary_cards),
    "headline_cards": _ranged(summary.headline_cards),
    "personal_records": _ranged(summary.personal_records),
    "training_records": _ranged(summary.training_records),
    "prior_period_summary": _ranged(period.prior_period_summary),
    "period_deltas": _ranged(period.period_deltas),
    "sparklines": _ranged(summary.sparklines),
    "monthly_flags": lambda t: period.monthly_flags(daily.monthly_summary(t, START, END)),
    "series_cards": _ranged(summary.series_cards),
    # Periods and digest
    "period_windows": _ranged(period.period_windows),
    "step_stats": _ranged(period.step_stats),
    "heart_rate_stats": _ranged(period.heart_rate_stats),
    "sleep_stats": _ranged(period.sleep_stats),
    "workout_stats": _ranged(period.workout_totals),
    "workout_stats_by_type": _ranged(period.workout_types),
    "ring_stats": _ranged(period.ring_stats),
    "period_stats": _stats_row,
    "period_digest": lambda t: digest.period_digest(period.period_stats(t, START, END)),
    "question_digest": lambda t: digest.question_digest(period.period_stats(t, START, END), QUESTION),
    # Loading, profile and output
    "parsed_records": parsed_records,
    "parsed_workouts": parsed_workouts,
    "parsed_activity": parsed_activity,
    "parsed_profile": parsed_profile,
    "parsed_route_points": parsed_route_points,
    "parsed_nights": parsed_nights,
    "profile_wide": lambda t: profile.profile_wide(t.profile),
    "profile_upsert": lambda t: profile.upsert_profile(t.profile, profile_updates(t), order_by="version"),
    "load_row_counts": row_counts,
    "load_top_types": lambda t: top_record_types(t.records),
    "stored_row_counts": stored_row_counts,
    "json_payload": _json_payload,
}


def _bind(operator: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(derive_tables(spark, sf_dir))


def all_queries() -> dict[str, Query]:
    return {name: _bind(operator) for name, operator in ON_TABLES.items()}
