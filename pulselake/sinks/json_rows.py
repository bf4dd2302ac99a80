"""Result sets as JSON: one object per row, written side by side, so no subject's data is gathered anywhere."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.operators import daily, routes, sleep, workouts
from pulselake.tables import Tables


# The fixed dataset names of the dashboard and the operator behind each.
DATASETS: dict[str, Callable[[Tables, date, date], DataFrame]] = {
    "steps": daily.steps_series,
    "heart_rate": daily.heart_rate_series,
    "activity_rings": daily.rings_series,
    "sleep": sleep.sleep_series,
    "workout_types": workouts.type_counts,
    "running_pace": workouts.running_pace,
    "weekly_workouts": workouts.weekly_counts,
    "heatmap": workouts.workout_heatmap,
    "day_of_week": daily.weekday_profile,
    "correlation": daily.correlation_rows,
    "vo2max": daily.vo2max_series,
    "hrv": daily.hrv_series,
    "respiratory": daily.respiratory_series,
    "spo2": daily.spo2_series,
    "sleep_stages": sleep.stages_series,
    "walking_speed": daily.walking_speed_series,
    "flights": daily.flights_series,
    "running_mechanics": workouts.running_mechanics,
    "running_distance": workouts.running_distance,
    "cycling": workouts.cycling_sessions,
    "weekly_volume": workouts.weekly_minutes,
    "sleep_efficiency": sleep.efficiency_series,
    "sleep_latency": sleep.latency_series,
    "snore": sleep.snore_series,
    "sleep_hr": sleep.night_heart_rate,
    "sleep_regularity": sleep.regularity_series,
    "sleep_environment": sleep.sleep_environment,
    "sleep_impact": sleep.sleep_impact,
    "weight": daily.weight_series,
    "sleep_score": sleep.score_series,
    "hr_zones": daily.heart_rate_zones,
    "bmi": daily.bmi_series,
    "routes": routes.workout_routes,
}


def dashboard_datasets(t: Tables, s: date, e: date, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Every series of the dashboard under its fixed name, or only the named ones."""
    return {name: DATASETS[name](t, s, e) for name in (DATASETS if names is None else names)}


def json_rows(datasets: dict[str, DataFrame]) -> DataFrame:
    """All datasets as (dataset, subject_id, json); NULL fields are written as null."""

    def rows(name: str, df: DataFrame) -> DataFrame:
        fields = [c for c in df.columns if c != "subject_id"]
        payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
        return df.select(F.lit(name).alias("dataset"), "subject_id", payload.alias("json"))

    return reduce(DataFrame.unionByName, [rows(name, df) for name, df in datasets.items()])


def write_json(datasets: dict[str, DataFrame], path: str) -> None:
    """JSON lines per dataset folder, replacing what was there. Each dataset is its own job: one slow series
    does not hold the others in one giant plan."""
    for name, df in datasets.items():
        df.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/dataset={name}")
