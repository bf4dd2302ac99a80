"""Hand-derived results on the three-day dataset."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

import pytest
from conftest import E, S, SEED_RECORDS, frame, record, rows

from pulselake.operators import daily, digest, period, sleep, summary, views, workouts


def test_steps(seeded):
    assert rows(daily.steps_series(seeded, S, E)) == [
        ("06-01", 8000, 8000),
        ("06-02", 7000, 7500),
        ("06-03", 6000, 7000),
    ]


def test_heart_rate(seeded):
    assert rows(daily.heart_rate_series(seeded, S, E)) == [
        ("06-01", 78.5, 72.0, 85.0, 55.0),
        ("06-02", 68.0, 68.0, 68.0, 53.0),
    ]


def test_rings_and_calendar(seeded):
    assert len(rows(daily.rings_series(seeded, S, E))) == 3
    assert rows(daily.activity_calendar(seeded, S, E), "date", "rings") == [("06-01", 3), ("06-02", 3), ("06-03", 0)]


def test_weekday_profile(seeded):
    assert rows(daily.weekday_profile(seeded, S, E), "day", "avg_steps", "avg_workout_min", "avg_sleep_hrs") == [
        ("Mon", 7000, 45.0, 6.7),
        ("Sun", 8000, 30.0, 7.0),
        ("Tue", 6000, 60.0, 0.0),
    ]


def test_monthly(seeded):
    assert rows(daily.monthly_summary(seeded, S, E)) == [("2025-06", 21000, 7000, 3, 135.0, 6.8, 54.0, 42.8, 47.5)]


def test_spo2_zones_max_rate(seeded):
    assert rows(daily.spo2_series(seeded, S, E)) == [("06-01", 97.0, 97.0)]
    assert rows(daily.heart_rate_zones(seeded, S, E, 190), "week", "rest", "fat_burn", "max_zone") == [
        ("05-26", 2, 0, 0),
        ("06-02", 1, 0, 0),
    ]
    assert rows(daily.max_heart_rate(seeded, E)) == [(185,)]


@pytest.mark.parametrize(
    ("profile", "expected"),
    [
        ([], 190),
        ([("age", "35")], 185),
        ([("age", "old")], 190),
        ([("age", "old"), ("date_of_birth", "1990-06-03")], 190),
        ([("date_of_birth", "1990-06-03")], 220 - 35),
        ([("date_of_birth", "soon")], 190),
    ],
)
def test_max_rate_from_profile(spark, nobody, profile, expected):
    tables = replace(nobody, profile=frame(spark, "profile", [{"key": k, "value": v} for k, v in profile]))
    assert rows(daily.max_heart_rate(tables, E)) == [(expected,)]


def test_bmi(spark, seeded):
    weighed = replace(seeded, records=frame(spark, "records", [*SEED_RECORDS, record("BodyMass", "06-01 07:00", None, 175.0)]))
    assert rows(daily.bmi_series(weighed, S, E)) == [("06-01", 25.1, 25.1)]
    assert rows(daily.bmi_series(weighed, S, E, 70.0)) == [("06-01", 25.1, 25.1)]
    assert rows(daily.bmi_series(replace(weighed, profile=frame(spark, "profile", [])), S, E)) == []
    assert rows(daily.weight_series(weighed, S, E)) == [("06-01", 175.0)]


def test_week_review(seeded):
    got = rows(daily.week_review(seeded, E))
    assert [r[0] for r in got] == ["05-28", "05-29", "05-30", "05-31", "06-01", "06-02", "06-03"]
    assert [r[1] for r in got] == ["Wed", "Thu", "Fri", "Sat", "Sun", "Mon", "Tue"]
    assert [r[2] for r in got] == [False] * 4 + [True] * 3
    assert [r[3] for r in got] == [0, 0, 0, 0, 3, 3, 0]


def test_record_series_arguments(seeded):
    assert rows(daily.daily_record_series(seeded, S, E, "FlightsClimbed", "SUM", 2)) == [
        ("06-01", 5.0, 5.0),
        ("06-02", 8.0, 6.5),
    ]
    with pytest.raises(ValueError, match="aggregate"):
        daily.daily_record_series(seeded, S, E, "VO2Max", "MEDIAN")
    with pytest.raises(ValueError, match="window"):
        daily.daily_record_series(seeded, S, E, "VO2Max", ma_window=0)


def test_views(seeded):
    by_start = {r[0]: r[1:] for r in rows(views.workout_summary(seeded), "start_date", "avg_speed", "avg_heart_rate")}
    assert sorted(v for v in by_start.values() if v[0]) == [(3.0, None)]
    assert rows(views.sleep_combined(seeded), "date", "source") == [("06-01", "sleep_cycle"), ("06-02", "sleep_cycle")]
    assert rows(views.daily_summary(seeded), "date", "steps", "distance", "resting_hr") == [
        ("06-01", 8000, 3.1, 55.0),
        ("06-02", 7000, 5.2, 53.0),
        ("06-03", 6000, None, None),
    ]


def test_undated_app_night_hides_device_nights(spark, seeded):
    device_only = replace(seeded, sleep=frame(spark, "sleep", []))
    assert rows(views.sleep_combined(device_only), "date", "source") == [("06-01", "apple_health")]
    undated = replace(seeded, sleep=frame(spark, "sleep", [{"time_asleep_seconds": 100.0}]))
    assert rows(views.sleep_combined(undated), "source") == [("sleep_cycle",)]
    other = replace(seeded, sleep=frame(spark, "sleep", [{"subject_id": 2, "time_asleep_seconds": 100.0}]))
    assert ("apple_health",) in rows(views.sleep_combined(other), "source")


def test_workouts(seeded):
    assert rows(workouts.running_pace(seeded, S, E)) == [
        ("06-01", 30.0, None, 6.71, 8.94),
        ("06-02", 45.0, None, None, None),
    ]
    assert rows(workouts.running_distance(seeded, S, E)) == [("06-01", 3.1, 30.0), ("06-02", 5.2, 45.0)]
    assert rows(workouts.cycling_sessions(seeded, S, E)) == [("06-03", None, 60.0, None)]
    ride, run = "HKWorkoutActivityTypeCycling", "HKWorkoutActivityTypeRunning"
    assert rows(workouts.weekly_counts(seeded, S, E)) == [("05-26", run, 1), ("06-02", ride, 1), ("06-02", run, 1)]
    assert rows(workouts.weekly_minutes(seeded, S, E)) == [("05-26", run, 30), ("06-02", ride, 60), ("06-02", run, 45)]
    assert rows(workouts.workout_heatmap(seeded, S, E), "dow", "total_min") == [(0, 30.0), (1, 45.0), (2, 60.0)]
    assert rows(workouts.running_mechanics(seeded, S, E)) == [("06-01", 250.0, 240.0, 8.5, 3.0)]


def test_streaks(seeded):
    assert rows(workouts.longest_streak(seeded, S, E)) == [(3,)]
    assert rows(workouts.current_streak(seeded, E, compat=False)) == [(3,)]
    assert rows(workouts.consistency(seeded, S, E)) == [(1, 0.0, 1.0)]


def test_sleep_series(seeded):
    assert rows(sleep.sleep_series(seeded, S, E), "date", "hours") == [("06-01", 7.0), ("06-02", 6.67)]
    assert rows(sleep.stages_series(seeded, S, E)) == [("06-01", 2.0, 3.0, 1.0, 0.33), ("06-02", 1.83, 3.17, 0.83, 0.5)]
    assert rows(sleep.efficiency_series(seeded, S, E)) == [("06-01", 87.5, 87.5), ("06-02", 83.3, 85.4)]
    assert rows(sleep.latency_series(seeded, S, E)) == [("06-01", 10.0, 10.0), ("06-02", 15.0, 12.5)]
    assert rows(sleep.snore_series(seeded, S, E)) == [("06-01", 5.0, 5.0), ("06-02", 7.5, 6.3)]
    assert rows(sleep.regularity_series(seeded, S, E)) == [("06-01", 75.0, 75.0), ("06-02", 70.0, 72.5)]
    assert rows(sleep.night_heart_rate(seeded, S, E)) == [("06-01", 58.0, 55.0), ("06-02", 60.0, 53.0)]
    assert rows(sleep.sleep_environment(seeded, S, E)) == []
    assert rows(sleep.sleep_impact(seeded, S, E)) == [
        ("06-02", 7.0, 82.0, 7000, 53.0, 45.0),
        ("06-03", 6.7, 78.0, 6000, None, 60.0),
    ]
    assert rows(sleep.score_series(seeded, S, E)) == [("06-01", 93, 93), ("06-02", 88, 90)]


def test_environment_without_bounds(spark, seeded):
    """No night has both readings: a present reading fails, a night without readings passes."""
    nights = [
        {"start_time": SEED_RECORDS[0]["start_date"], "weather_temperature_f": 60.0},
        {"start_time": SEED_RECORDS[2]["start_date"]},
    ]
    tables = replace(seeded, sleep=frame(spark, "sleep", nights))
    assert rows(sleep.sleep_environment(tables, S, E), "date") == [("06-02",)]


def test_summary_cards(seeded):
    card = summary.summary_cards(seeded, S, E).first().asDict()
    expected = {
        "avg_steps": 7000,
        "avg_resting_hr": 54.0,
        "workouts": 3,
        "ring_close_pct": 66.7,
        "longest_run_mi": 5.2,
        "total_run_mi": 8,
        "workout_streak": 3,
        "active_days": 3,
        "total_workout_hrs": 2,
        "vo2max_latest": 43.0,
        "vo2max_peak": 43.0,
        "avg_hrv": 48,
        "total_flights": 13,
        "avg_spo2": 97.0,
        "avg_run_power": 250,
        "run_count": 2,
        "avg_run_dur": 38,
        "avg_deep_sleep": 1.9,
        "avg_rem_sleep": 0.9,
        "best_sleep_quality": 82,
        "total_calories": 0,
        "marathons": 0,
        "strength_count": 0,
    }
    assert {k: card[k] for k in expected} == expected
    assert len(card) == 37


def test_records(seeded):
    assert rows(summary.personal_records(seeded, S, E)) == sorted(
        [
            ("Most Steps", "8,000", "06-01"),
            ("Lowest Resting HR", "53.0 bpm", "06-02"),
            ("Peak VO2Max", "43.0", "06-02"),
            ("Best Sleep Quality", "82%", "06-01"),
            ("Most Flights", "8", "06-02"),
        ]
    )
    assert rows(summary.training_records(seeded, S, E)) == sorted(
        [
            ("Longest Workout", "60 min (Cycling)", "2025-06-03"),
            ("Peak Run Power", "250 W", "2025-06-01"),
            ("Busiest Week", "2 workouts", "Week of 2025-06-02"),
            ("Most Steps (Day)", "8,000", "2025-06-01"),
        ]
    )


def test_period_stats(seeded):
    assert rows(period.prior_period_summary(seeded, S, E)) == [(0, None, None, None)]
    assert rows(period.step_stats(seeded, S, E)) == [(21000, 7000, 6000, 8000, 0)]
    assert rows(period.heart_rate_stats(seeded, S, E)) == [(54.0, 53.0, 55.0, 73.3, 68.0, 85.0, None)]
    assert rows(period.sleep_stats(seeded, S, E)) == [(6.8, 6.7, 7.0, 2, 80.0, None, 115.0, 185.0, 55.0, 25.0)]
    assert rows(period.workout_totals(seeded, S, E)) == [(3, 135.0, 0.0, 0.0)]
    assert rows(period.workout_types(seeded, S, E), "type", "count", "total_min") == [
        ("HKWorkoutActivityTypeCycling", 1, 60.0),
        ("HKWorkoutActivityTypeRunning", 2, 75.0),
    ]
    assert rows(period.ring_stats(seeded, S, E)) == [(3, 66.7, 66.7, 66.7, 2)]


def test_deltas(spark, seeded):
    """Second day against the first: fewer steps are bad, a lower resting rate is good."""
    got = {r[0]: r[1:] for r in rows(period.period_deltas(seeded, date(2025, 6, 2), date(2025, 6, 2)))}
    assert got["avg_steps"] == (7000.0, 8000.0, "-12%", "bad")
    assert got["avg_resting_hr"] == (53.0, 55.0, "-4%", "good")
    assert got["avg_hrv"] == (50.0, 45.0, "+11%", "good")


def test_digest(seeded):
    text = digest.period_digest(period.period_stats(seeded, S, E)).first()["digest"]
    assert text.startswith("# Health data for 2025-06-01 to 2025-06-03\nPeriod length: 2 days\n\n## User Profile\n- Age: 35 years")
    assert "- Height: 70 inches\n\n## Steps\n- Daily average: 7,000\n- Total: 21,000" in text
    assert "Prior period" not in text
    assert "- Resting HR range: 53.0 - 55.0 bpm\n- Overall HR range: 68.0 - 85.0 bpm" in text
    assert "- Sleep stages avg: 115min deep, 185min light, 55min dream, 25min awake" in text
    assert "- Total workouts: 3\n- Total duration: 135 minutes\n- Breakdown by type:\n  - Running: 2x (75 min)" in text
    assert text.endswith("- All three rings closed: 2 days")
    asked = digest.question_digest(period.period_stats(seeded, S, E), "How did I sleep?").first()["digest"]
    assert asked == f"## My question\n\nHow did I sleep?\n\n---\n\n## My health data\n\n{text}"


def test_sparkline_keeps_the_last_values(spark, seeded):
    df = daily.steps_series(seeded, S, E)
    assert rows(summary.sparkline(df, "steps", "steps", ["date"], points=2), "place", "value") == [(1, 7000.0), (2, 6000.0)]
