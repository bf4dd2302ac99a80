"""Every operator on tables without rows: nothing, or the documented zero rows."""

from __future__ import annotations

import pytest
from conftest import E, S, rows

from pulselake.operators import daily, digest, period, routes, sleep, summary, workouts
from pulselake.sinks.json_rows import DATASETS


@pytest.mark.parametrize("name", DATASETS)
def test_series_are_empty(nobody, name):
    assert DATASETS[name](nobody, S, E).count() == 0


def test_calendars_keep_their_days(nobody):
    assert rows(daily.activity_calendar(nobody, S, E), "rings") == [(0,)] * 3
    assert len(rows(daily.week_review(nobody, E))) == 7
    assert rows(daily.monthly_summary(nobody, S, E)) == [("2025-06", *[None] * 8)]


def test_zero_rows(nobody):
    card = summary.summary_cards(nobody, S, E).first()
    assert (card["avg_steps"], card["workouts"], card["longest_run_mi"], card["avg_hrv"]) == (0, 0, 0.0, None)
    assert rows(period.prior_period_summary(nobody, S, E)) == [(0, None, None, None)]
    assert rows(workouts.consistency(nobody, S, E)) == [(0, None, 0.0)]
    assert rows(period.step_stats(nobody, S, E)) == [(0, 0, 0, 0, 0)]
    assert rows(period.ring_stats(nobody, S, E)) == [(0, None, None, None, None)]
    assert summary.personal_records(nobody, S, E).count() == 0
    assert summary.training_records(nobody, S, E).count() == 0
    assert rows(summary.series_cards(nobody, S, E)) == [(None,) * 8]


def test_routes_are_empty(nobody):
    points = routes.sampled_points(nobody, S, E)
    assert points.count() == 0
    assert routes.elevation_gain(points).count() == 0
    assert routes.elevation_profile(points).count() == 0
    assert sleep.sleep_environment(nobody, S, E).count() == 0


def test_digest_without_data(nobody):
    text = digest.period_digest(period.period_stats(nobody, S, E)).first()["digest"]
    assert "User Profile" not in text and "Average sleep" not in text and "Breakdown" not in text
    assert text.endswith("## Activity Rings\n- Days tracked: 0")
