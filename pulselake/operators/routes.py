"""Recorded tracks: matching workout, distance, downsampling, elevation and labels.

A track is the key (subject, file). Nothing here gathers a track into one task or one array: rows are ordered with
``with_running_total`` (sliced by hour) and neighbours are reached with ``in_blocks``.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.functions.calendar import day, elapsed_seconds, hour_bucket, ts_between_days, ts_lit
from pulselake.functions.numeric import half_even, nonzero, sql_round
from pulselake.functions.ordered import BLOCK_ROWS, in_blocks, with_running_total
from pulselake.operators.intervals import overlapping
from pulselake.operators.workouts import MPH_PER_MS
from pulselake.tables import Tables

# Earth radius in miles, feet per metre, and the dashboard's number of points for a track.
EARTH_RADIUS_MI = 3959
FEET_PER_M = 3.28084
MAX_POINTS = 200
UTC_OFFSET_HOURS = 7
TYPE_PREFIX = "HKWorkoutActivityType"

ROUTE = ["subject_id", "gpx_file"]


def _shift(ts: Column, hours: int) -> Column:
    return ts - F.expr(f"make_dt_interval(0, {int(hours)})")


def recent_routes(
    t: Tables, s: date, e: date, limit: int | None = None, utc_offset_hours: int = UTC_OFFSET_HOURS
) -> DataFrame:
    """Tracks with points in the range, all or the newest ``limit`` of each subject; start and end in local time.

    Points fold to one row per track; a rank limit is applied map-side by Spark.
    """
    tracks = (
        t.route_points.where(ts_between_days(F.col("recorded_at"), s, e))
        .groupBy(*ROUTE)
        .agg(
            F.min("recorded_at").alias("first_point"),
            F.max("recorded_at").alias("last_point"),
            F.count(F.lit(1)).alias("pt_count"),
        )
    )
    if limit is not None:
        newest = Window.partitionBy("subject_id").orderBy(F.desc("first_point"), F.asc("gpx_file"))
        tracks = tracks.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit)
    return tracks.select(
        *ROUTE,
        _shift(F.col("first_point"), utc_offset_hours).alias("route_start"),
        _shift(F.col("last_point"), utc_offset_hours).alias("route_end"),
        "pt_count",
    )


def match_workouts(routes: DataFrame, workouts: DataFrame) -> DataFrame:
    """For each track the overlapping workout with the nearest start (then earliest, then by type name)."""
    sessions = workouts.select("subject_id", "start_date", "end_date", "workout_activity_type", "duration")
    pairs = overlapping(routes, sessions, ("route_start", "route_end"), ("start_date", "end_date"))
    apart = F.abs(elapsed_seconds(F.col("route_start"), F.col("start_date")))
    nearest = F.min(F.struct(apart.alias("apart"), "start_date", "workout_activity_type", "duration")).alias("w")
    return pairs.groupBy(*ROUTE).agg(nearest).select(*ROUTE, "w.start_date", "w.workout_activity_type", "w.duration")


def ordered_points(t: Tables, routes: DataFrame) -> DataFrame:
    """All points of the given tracks (also those outside the range) with ``pos`` and ``total``.

    Points of one time stand as in the file; points that cannot be told apart even so, by their values.
    """
    in_file = ["recorded_at", "segment", "point_no"]
    points = t.route_points.select(*ROUTE, *in_file, "latitude", "longitude", "elevation", "speed")
    chosen = points.join(routes.select(*ROUTE), ROUTE, "left_semi")
    order = [F.asc_nulls_last(c) for c in (*in_file, "latitude", "longitude", "elevation", "speed")]
    return with_running_total(chosen, ROUTE, hour_bucket(F.col("recorded_at")), order)


def haversine_miles(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    half_lat = F.sin(F.radians(lat2 - lat) / 2)
    half_lon = F.sin(F.radians(lon2 - lon) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(EARTH_RADIUS_MI) * 2 * F.asin(F.sqrt(chord))


def route_distances(points: DataFrame) -> DataFrame:
    """Miles along each track, from ordered points."""
    blocks = in_blocks(points.select(*ROUTE, "pos", "latitude", "longitude"), back=1)
    along = Window.partitionBy(*ROUTE, "_block").orderBy("pos")
    step = haversine_miles(
        F.lag("latitude").over(along), F.lag("longitude").over(along), F.col("latitude"), F.col("longitude")
    )
    steps = blocks.select(*ROUTE, "_carried", step.alias("mi")).where(~F.col("_carried"))
    return steps.groupBy(*ROUTE).agg(sql_round(F.sum("mi"), 2).alias("miles"))


def route_distance_table(t: Tables, s: date, e: date, limit: int | None = None) -> DataFrame:
    return route_distances(ordered_points(t, recent_routes(t, s, e, limit)))


def workout_routes(
    t: Tables, s: date, e: date, limit: int | None = None, utc_offset_hours: int = UTC_OFFSET_HOURS
) -> DataFrame:
    """One row per track: matched workout, its day and length, track distance and points in range."""
    routes = recent_routes(t, s, e, limit, utc_offset_hours)
    # A matching workout must touch the (shifted) range, so others need not be read.
    reach = timedelta(days=1 + abs(utc_offset_hours) // 24)
    near = t.workouts.where(
        (F.col("end_date") >= ts_lit(s - reach)) & (F.col("start_date") < ts_lit(e + timedelta(days=1) + reach))
    )
    matched = match_workouts(routes, near)
    miles = route_distances(ordered_points(t, routes))
    kind = F.replace(F.col("workout_activity_type"), F.lit(TYPE_PREFIX), F.lit(""))
    return (
        routes.join(matched, ROUTE, "left")
        .join(miles, ROUTE, "left")
        .select(
            *ROUTE,
            "route_start",
            F.when(F.length("workout_activity_type") > 0, kind).alias("workout_type"),
            day(F.col("start_date")).alias("date"),
            nonzero(sql_round(F.col("duration"), 1)).alias("duration_min"),
            nonzero(F.col("miles")).alias("distance_mi"),
            "pt_count",
        )
    )


def sampled_points(
    t: Tables, s: date, e: date, limit: int | None = None, max_pts: int = MAX_POINTS
) -> DataFrame:
    """Every n-th point of each track, always with its first and last.

    n comes from the points in the range, while the points themselves are those of the whole track.
    """
    routes = recent_routes(t, s, e, limit)
    every = F.greatest(F.lit(1).cast("bigint"), F.expr(f"pt_count div {int(max_pts)}"))
    return (
        ordered_points(t, routes)
        .join(routes.select(*ROUTE, every.alias("_every")), ROUTE, "inner")
        .where((F.col("pos") == 1) | (F.col("pos") % F.col("_every") == 0) | (F.col("pos") == F.col("total")))
        .select(*ROUTE, "pos", "latitude", "longitude", "elevation", "speed")
    )


def _mapped_tracks(points: DataFrame) -> DataFrame:
    """Tracks that can be drawn: at least one point with both coordinates present and not zero."""
    usable = (nonzero(F.col("latitude")).isNotNull()) & (nonzero(F.col("longitude")).isNotNull())
    return points.where(usable).select(*ROUTE).distinct()


def elevation_gain(points: DataFrame) -> DataFrame:
    """Feet climbed over the given points with a known elevation; NULL below two of them."""
    known = points.where(F.col("elevation").isNotNull()).select(*ROUTE, F.col("pos").alias("_at"), "elevation")
    placed = with_running_total(known, ROUTE, F.floor(F.col("_at") / BLOCK_ROWS), [F.col("_at")])
    along = Window.partitionBy(*ROUTE, "_block").orderBy("pos")
    rise = F.greatest(F.lit(0.0), F.col("elevation") - F.lag("elevation").over(along))
    climbs = in_blocks(placed, back=1).select(
        *ROUTE, "_carried", "total", F.when(F.col("pos") > 1, rise).alias("rise")
    )
    gains = (
        climbs.where(~F.col("_carried"))
        .groupBy(*ROUTE)
        .agg(half_even(F.sum("rise") * FEET_PER_M).alias("gain"), F.max("total").alias("n"))
        .select(*ROUTE, F.when(F.col("n") > 1, F.col("gain")).alias("ele_gain_ft"))
    )
    return _mapped_tracks(points).join(gains, ROUTE, "left")


def elevation_profile(points: DataFrame) -> DataFrame:
    """Feet and miles per hour at each given point with a known elevation."""
    drawn = points.join(_mapped_tracks(points), ROUTE, "left_semi")
    return drawn.where(F.col("elevation").isNotNull()).select(
        *ROUTE,
        "pos",
        half_even(F.col("elevation") * FEET_PER_M).alias("ele_ft"),
        half_even(nonzero(F.col("speed")) * MPH_PER_MS, 1).alias("speed_mph"),
    )


def route_labels(summaries: DataFrame) -> DataFrame:
    """Dropdown label and pace (m:ss per mile) of each track from ``workout_routes``."""
    miles, minutes = F.col("distance_mi"), F.col("duration_min")
    extras = F.concat_ws(
        ", ",
        F.when(miles.isNotNull(), F.format_string("%.1f mi", half_even(miles, 1))),
        F.when(minutes.isNotNull(), F.format_string("%d min", minutes.cast("bigint"))),
    )
    label = F.concat_ws(
        " — ",
        F.date_format("date", "MMM dd"),
        F.col("workout_type"),
        F.when(extras != "", F.concat(F.lit("("), extras, F.lit(")"))),
    )
    name = F.replace(F.col("gpx_file"), F.lit(".gpx"), F.lit(""))
    pace = F.try_divide(minutes, miles)
    whole = F.floor(pace)
    seconds = F.floor((pace - whole) * 60 + 0.5)
    return summaries.select(
        *ROUTE,
        F.when(label != "", label).otherwise(name).alias("label"),
        F.when(pace > 0, F.format_string("%d:%02d", whole, seconds)).alias("pace"),
    )
