"""Schemas of the base tables and the ``Tables`` bundle every operator takes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NTZ = T.TimestampNTZType()
_STR = T.StringType()
_DBL = T.DoubleType()
_LONG = T.LongType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("subject_id", T.LongType())] + [T.StructField(n, t) for n, t in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "records": _schema(
        source_name=_STR,
        source_version=_STR,
        device=_STR,
        record_type=_STR,
        unit=_STR,
        creation_date=_NTZ,
        start_date=_NTZ,
        end_date=_NTZ,
        value=_DBL,
    ),
    "workouts": _schema(
        source_name=_STR,
        source_version=_STR,
        device=_STR,
        creation_date=_NTZ,
        start_date=_NTZ,
        end_date=_NTZ,
        workout_activity_type=_STR,
        duration=_DBL,
        duration_unit=_STR,
        total_distance=_DBL,
        total_distance_unit=_STR,
        total_energy_burned=_DBL,
        total_energy_burned_unit=_STR,
    ),
    "activity": _schema(
        date_components=T.DateType(),
        active_energy_burned=_DBL,
        active_energy_burned_goal=_DBL,
        active_energy_burned_unit=_STR,
        apple_exercise_time=_DBL,
        apple_exercise_time_goal=_DBL,
        apple_stand_hours=_DBL,
        apple_stand_hours_goal=_DBL,
    ),
    "route_points": _schema(
        gpx_file=_STR,
        workout_name=_STR,
        segment=_LONG,
        point_no=_LONG,
        recorded_at=_NTZ,
        latitude=_DBL,
        longitude=_DBL,
        elevation=_DBL,
        speed=_DBL,
        course=_DBL,
        horiz_accuracy=_DBL,
        vert_accuracy=_DBL,
    ),
    "sleep": _schema(
        start_time=_NTZ,
        end_time=_NTZ,
        sleep_quality=_DBL,
        regularity=_DBL,
        awake_seconds=_DBL,
        dream_seconds=_DBL,
        light_seconds=_DBL,
        deep_seconds=_DBL,
        mood=_STR,
        heart_rate_bpm=_DBL,
        steps=T.IntegerType(),
        alarm_mode=_STR,
        air_pressure_pa=_DBL,
        city=_STR,
        movements_per_hour=_DBL,
        time_in_bed_seconds=_DBL,
        time_asleep_seconds=_DBL,
        time_before_sleep_seconds=_DBL,
        window_start=_NTZ,
        window_stop=_NTZ,
        snore_time_seconds=_DBL,
        weather_temperature_f=_DBL,
        weather_type=_STR,
        notes=_STR,
        body_temp_deviation_c=_DBL,
    ),
    "profile": _schema(key=_STR, value=_STR),
    "subjects": _schema(),
}

PROFILE_KEYS = ["age", "sex", "weight_lbs", "height_in", "date_of_birth"]

# The record types the analytics read; any other type is carried along and ignored.
RECORD_TYPES = [
    "StepCount",
    "HeartRate",
    "RestingHeartRate",
    "VO2Max",
    "HeartRateVariabilitySDNN",
    "RespiratoryRate",
    "OxygenSaturation",
    "WalkingSpeed",
    "FlightsClimbed",
    "DistanceWalkingRunning",
    "DistanceCycling",
    "ActiveEnergyBurned",
    "BodyMass",
    "RunningSpeed",
    "RunningPower",
    "RunningGroundContactTime",
    "RunningVerticalOscillation",
    "SleepAnalysis",
]


@dataclass(frozen=True)
class Tables:
    """The base tables. ``subjects`` lists who exists, so calendars and cards also cover people without rows."""

    records: DataFrame
    workouts: DataFrame
    activity: DataFrame
    route_points: DataFrame
    sleep: DataFrame
    profile: DataFrame
    subjects: DataFrame

    def of_type(self, *record_types: str) -> DataFrame:
        """Records of the given types; the predicate prunes partitions when stored by ``record_type``."""
        return self.records.where(F.col("record_type").isin(*record_types))

    def register_views(self) -> None:
        """Expose the tables to ``spark.sql`` as temporary views."""
        for name in SCHEMAS:
            getattr(self, name).createOrReplaceTempView(name)


def empty_tables(spark: SparkSession) -> Tables:
    return Tables(**{name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})
