from __future__ import annotations

import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pulselake.session import build_session
from pulselake.tables import SCHEMAS, Tables, empty_tables

S, E = date(2025, 6, 1), date(2025, 6, 3)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "pulselake-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    """'06-01 08:00' in 2025."""
    return datetime.strptime(f"2025-{text}", "%Y-%m-%d %H:%M")


def frame(spark, table: str, rows: list[dict]):
    """Rows given as dicts; missing columns are NULL, the subject is 1."""
    schema = SCHEMAS[table]
    return spark.createDataFrame([tuple(({"subject_id": 1} | r).get(n) for n in schema.names) for r in rows], schema)


def record(kind: str, start: str, end: str | None = None, value: float | None = None, **more) -> dict:
    return {"record_type": kind, "start_date": at(start), "end_date": at(end or start), "value": value} | more


SEED_RECORDS = [
    record("StepCount", "06-01 08:00", "06-01 08:30", 3000.0),
    record("StepCount", "06-01 12:00", "06-01 12:30", 5000.0),
    record("StepCount", "06-02 08:00", "06-02 08:30", 7000.0),
    record("StepCount", "06-03 08:00", "06-03 08:30", 6000.0),
    record("HeartRate", "06-01 08:00", "06-01 08:01", 72.0),
    record("HeartRate", "06-01 12:00", "06-01 12:01", 85.0),
    record("HeartRate", "06-02 08:00", "06-02 08:01", 68.0),
    record("RestingHeartRate", "06-01 06:00", None, 55.0),
    record("RestingHeartRate", "06-02 06:00", None, 53.0),
    record("VO2Max", "06-01 09:00", None, 42.5),
    record("VO2Max", "06-02 09:00", None, 43.0),
    record("HeartRateVariabilitySDNN", "06-01 06:00", None, 45.0),
    record("HeartRateVariabilitySDNN", "06-02 06:00", None, 50.0),
    record("RespiratoryRate", "06-01 03:00", None, 14.5),
    record("OxygenSaturation", "06-01 03:00", None, 0.97),
    record("WalkingSpeed", "06-01 10:00", None, 1.4),
    record("FlightsClimbed", "06-01 10:00", None, 5.0),
    record("FlightsClimbed", "06-02 10:00", None, 8.0),
    record("DistanceWalkingRunning", "06-01 07:00", "06-01 07:30", 3.1),
    record("DistanceWalkingRunning", "06-02 07:00", "06-02 07:45", 5.2),
    record("RunningSpeed", "06-01 07:00", "06-01 07:30", 3.0),
    record("RunningPower", "06-01 07:00", "06-01 07:30", 250.0),
    record("RunningStrideLength", "06-01 07:00", "06-01 07:30", 1.2),
    record("RunningVerticalOscillation", "06-01 07:00", "06-01 07:30", 8.5),
    record("RunningGroundContactTime", "06-01 07:00", "06-01 07:30", 240.0),
    record("SleepAnalysis", "06-01 22:00", "06-02 06:00"),
]


def workout(kind: str, start: str, end: str, minutes: float, **more) -> dict:
    return {
        "workout_activity_type": f"HKWorkoutActivityType{kind}",
        "start_date": at(start),
        "end_date": at(end),
        "duration": minutes,
        "duration_unit": "min",
    } | more


SEED_WORKOUTS = [
    workout("Running", "06-01 07:00", "06-01 07:30", 30.0),
    workout("Running", "06-02 07:00", "06-02 07:45", 45.0),
    workout("Cycling", "06-03 08:00", "06-03 09:00", 60.0),
]


def rings(day: int, energy: float, exercise: float, stand: float) -> dict:
    return {
        "date_components": date(2025, 6, day),
        "active_energy_burned": energy,
        "active_energy_burned_goal": 400.0,
        "apple_exercise_time": exercise,
        "apple_exercise_time_goal": 30.0,
        "apple_stand_hours": stand,
        "apple_stand_hours_goal": 12.0,
    }


SEED_ACTIVITY = [rings(1, 450.0, 35.0, 12.0), rings(2, 500.0, 40.0, 14.0), rings(3, 350.0, 25.0, 10.0)]

_NIGHT = (
    "sleep_quality regularity awake_seconds dream_seconds light_seconds deep_seconds heart_rate_bpm movements_per_hour "
    "time_in_bed_seconds time_asleep_seconds time_before_sleep_seconds snore_time_seconds weather_temperature_f"
).split()


def night(start: str, end: str, *values: float) -> dict:
    return {"start_time": at(start), "end_time": at(end)} | dict(zip(_NIGHT, map(float, values), strict=True))


SEED_SLEEP = [
    night("06-01 22:30", "06-02 06:30", 0.82, 0.75, 1200, 3600, 10800, 7200, 58, 4.2, 28800, 25200, 600, 300, 68),
    night("06-02 23:00", "06-03 07:00", 0.78, 0.70, 1800, 3000, 11400, 6600, 60, 5.1, 28800, 24000, 900, 450, 70),
]
SEED_PROFILE = [
    {"key": "age", "value": "35"},
    {"key": "sex", "value": "male"},
    {"key": "weight_lbs", "value": "175"},
    {"key": "height_in", "value": "70"},
]


@pytest.fixture(scope="session")
def seeded(spark) -> Tables:
    return Tables(
        records=frame(spark, "records", SEED_RECORDS),
        workouts=frame(spark, "workouts", SEED_WORKOUTS),
        activity=frame(spark, "activity", SEED_ACTIVITY),
        route_points=frame(spark, "route_points", []),
        sleep=frame(spark, "sleep", SEED_SLEEP),
        profile=frame(spark, "profile", SEED_PROFILE),
        subjects=frame(spark, "subjects", [{}]),
    )


@pytest.fixture(scope="session")
def nobody(spark) -> Tables:
    """No data, but one known subject."""
    from dataclasses import replace

    return replace(empty_tables(spark), subjects=frame(spark, "subjects", [{}]))


def rows(df, *columns: str) -> list[tuple]:
    """Sorted rows without the subject; dates as 'MM-DD'."""
    names = columns or [c for c in df.columns if c != "subject_id"]

    def cell(v):
        return v.strftime("%m-%d") if isinstance(v, date) else v

    found = [tuple(cell(v) for v in r) for r in df.select(*names).collect()]
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))
