"""Health-shaped tables derived from the driver's ``events`` table, row by row and in proportion to it.

Numbers come from ids by whole-number arithmetic and are multiples of a power of two, so sums are exact in any
order and Spark and the SQL check agree to the last digit. ``DERIVED_SQL`` states the same derivation for DuckDB.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.tables import RECORD_TYPES, SCHEMAS, Tables

# The range every registered query asks for.
START = date(2024, 2, 1)
END = date(2024, 3, 15)

WORKOUT_TYPES = [
    "Running",
    "Cycling",
    "Walking",
    "HIIT",
    "FunctionalStrengthTraining",
    "CoreTraining",
    "TraditionalStrengthTraining",
    "Yoga",
]

# Value of a record by type; q = event_id div 18, v = the event's value cut to quarters.
VALUES = {
    "StepCount": "500 + q % 4000 + 0.5D * (q % 2)",
    "HeartRate": "55 + q % 120 + 0.25D * (q % 4)",
    "RestingHeartRate": "48 + q % 20 + 0.25D * (q % 3)",
    "VO2Max": "35 + q % 15 + 0.125D * (q % 7)",
    "HeartRateVariabilitySDNN": "30 + q % 50 + 0.5D * (q % 3)",
    "RespiratoryRate": "12 + q % 8 + 0.25D * (q % 3)",
    "OxygenSaturation": "if(q % 5 = 0, 90D + q % 10, (57D + q % 8) / 64D)",
    "WalkingSpeed": "1 + 0.125D * (q % 8)",
    "FlightsClimbed": "q % 12 + 0D",
    "DistanceWalkingRunning": "v / 8D",
    "DistanceCycling": "v / 8D",
    "ActiveEnergyBurned": "v",
    "BodyMass": "140 + q % 80 + 0.5D * (q % 2)",
    "RunningSpeed": "2 + 0.125D * (q % 16)",
    "RunningPower": "180 + q % 120 + 0.5D * (q % 2)",
    "RunningGroundContactTime": "220 + q % 60 + 0D",
    "RunningVerticalOscillation": "7 + 0.125D * (q % 16)",
    "SleepAnalysis": "cast(null as double)",
}


def _pick(names: list[str], index: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"element_at(array({listed}), cast({index} as int) + 1)"


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a subject, whole-second times spread over three months, and the value in quarters."""
    whole_second = "ts - make_dt_interval(0, 0, 0, extract(second from ts) - second(ts))"
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id",
        "event_type",
        "user_id div 15 as subject_id",
        f"{whole_second} + make_dt_interval(cast(30 * (user_id % 3) as int)) as ts",
        "floor(value * 4) / 4.0D as v",
        "event_id div 18 as q",
    )


def records(base: DataFrame) -> DataFrame:
    slot = f"event_id % {len(RECORD_TYPES)}"
    values = " ".join(f"when {place} then {VALUES[name]}" for place, name in enumerate(RECORD_TYPES))
    # Seconds for most types, minutes for nights.
    night = RECORD_TYPES.index("SleepAnalysis")
    seconds = f"cast(event_id % 600 * if({slot} = {night}, 60, 1) as decimal(18, 6))"
    return base.selectExpr(
        "subject_id",
        "'watch' as source_name",
        "'1' as source_version",
        "cast(null as string) as device",
        f"{_pick(RECORD_TYPES, slot)} as record_type",
        "'u' as unit",
        "ts as creation_date",
        "ts as start_date",
        f"ts + make_dt_interval(0, 0, 0, {seconds}) as end_date",
        f"cast(case {slot} {values} end as double) as value",
    )


def workouts(base: DataFrame) -> DataFrame:
    minutes = "if(event_id % 11 = 0, 4, cast(60 + event_id % 120 as int))"
    return base.where("event_type = 'purchase' and (day(ts) + subject_id) % 4 <> 0").selectExpr(
        "subject_id",
        "'watch' as source_name",
        "'1' as source_version",
        "cast(null as string) as device",
        "ts as creation_date",
        "ts as start_date",
        f"ts + make_dt_interval(0, 0, {minutes}) as end_date",
        f"concat('HKWorkoutActivityType', {_pick(WORKOUT_TYPES, 'event_id % 8')}) as workout_activity_type",
        f"cast({minutes} as double) as duration",
        "'min' as duration_unit",
        "if(event_id % 5 = 0, null, v / 16D) as total_distance",
        "if(event_id % 2 = 0, 'km', 'mi') as total_distance_unit",
        "if(event_id % 7 = 0, null, v * 2D) as total_energy_burned",
        "'kcal' as total_energy_burned_unit",
    )


def activity(base: DataFrame) -> DataFrame:
    daily = base.groupBy("subject_id", F.to_date("ts").alias("d")).agg(
        F.sum("v").alias("energy"), F.count(F.lit(1)).alias("n"), F.sum(F.expr("event_id % 3")).alias("m")
    )
    return daily.where("(day(d) + subject_id) % 9 <> 0").selectExpr(
        "subject_id",
        "d as date_components",
        "energy as active_energy_burned",
        "if((day(d) + subject_id) % 13 = 0, 0D, 400D) as active_energy_burned_goal",
        "'kcal' as active_energy_burned_unit",
        "3D * n as apple_exercise_time",
        "30D as apple_exercise_time_goal",
        "m + 0.5D as apple_stand_hours",
        "10D as apple_stand_hours_goal",
    )


_SLEEP = {
    "start_time": "ts",
    "end_time": "ts + make_dt_interval(0, 8)",
    "sleep_quality": "(32D + event_id % 29) / 64D",
    "regularity": "if(event_id % 7 = 0, null, (30D + event_id % 31) / 64D)",
    "awake_seconds": "60D * (event_id % 40)",
    "dream_seconds": "60D * (40 + event_id % 60)",
    "light_seconds": "60D * (120 + event_id % 120)",
    "deep_seconds": "if(event_id % 23 = 0, null, 60D * (20 + event_id % 100))",
    "heart_rate_bpm": "if(event_id % 6 = 0, null, 48D + event_id % 20)",
    "air_pressure_pa": "100000D + event_id % 500",
    "movements_per_hour": "if(event_id % 10 = 0, null, 0.25D * (event_id % 64))",
    "time_in_bed_seconds": "if(event_id % 29 = 0, 0D, 60D * (360 + event_id % 180))",
    "time_asleep_seconds": "if(event_id % 31 = 0, 0D, 60D * (330 + event_id % 170))",
    "time_before_sleep_seconds": "if(event_id % 9 = 0, null, 30D * (event_id % 80))",
    "snore_time_seconds": "15D * (event_id % 200)",
    "weather_temperature_f": "if(event_id % 8 = 0, null, 30 + 0.5D * (event_id % 60))",
}


def _typed(table: str, columns: dict[str, str]) -> list[str]:
    """Expressions for all columns of a table in order and type; columns not given are NULL."""
    return [
        f"cast({columns.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}" for f in SCHEMAS[table].fields
    ]


def sleep(base: DataFrame) -> DataFrame:
    nights = base.where("event_type = 'signup' and event_id % 3 <> 2")
    return nights.selectExpr(*_typed("sleep", {"subject_id": "subject_id", **_SLEEP}))


def route_points(base: DataFrame) -> DataFrame:
    points = base.where("event_type = 'view'")
    week = "datediff(ts, date'2024-01-01') div 7"
    columns = {
        "subject_id": "subject_id",
        "gpx_file": f"concat('r', subject_id, '_', {week}, '.gpx')",
        "workout_name": f"concat('week ', {week})",
        "segment": "0",
        "point_no": "event_id",
        "recorded_at": "ts + make_dt_interval(0, 7)",
        "latitude": "47 + (event_id % 1000) / 1024D",
        "longitude": "-122 - (event_id % 997) / 1024D",
        "elevation": "if(event_id % 19 = 0, null, 0.25D * (event_id % 300))",
        "speed": "if(event_id % 17 = 0, null, 0.125D * (event_id % 40))",
        "course": "event_id % 360 + 0D",
        "horiz_accuracy": "5D",
        "vert_accuracy": "3D",
    }
    return points.selectExpr(*_typed("route_points", columns))


def subjects(base: DataFrame) -> DataFrame:
    return base.select("subject_id").distinct()


def profile(base: DataFrame) -> DataFrame:
    """Some subjects lack an age, have an unreadable one, or lack a height."""
    fields = {
        "age": "case when subject_id % 4 = 0 then null when subject_id % 7 = 6 then 'n/a' "
        "else cast(25 + subject_id % 40 as string) end",
        "date_of_birth": "if(subject_id % 8 = 0, concat(1960 + subject_id % 40, '-05-17'), null)",
        "sex": "if(subject_id % 2 = 0, 'female', 'male')",
        "weight_lbs": "cast(140 + subject_id % 80 as string)",
        "height_in": "if(subject_id % 3 = 0, null, cast(60 + subject_id % 15 as string))",
    }
    pairs = ", ".join(f"'{k}', {x}" for k, x in fields.items())
    return (
        subjects(base)
        .selectExpr("subject_id", f"stack({len(fields)}, {pairs}) as (key, value)")
        .where("value is not null")
    )


def derive_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables, as lazy plans."""
    base = base_events(spark, sf_dir)
    return Tables(
        records=records(base),
        workouts=workouts(base),
        activity=activity(base),
        route_points=route_points(base),
        sleep=sleep(base),
        profile=profile(base),
        subjects=subjects(base),
    )
