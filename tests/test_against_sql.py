"""Registered queries against their SQL in DuckDB.

Here run those whose values no other test pins down; ``python tests/compare.py`` runs all of them.
"""

from __future__ import annotations

import pytest
from compare import differences, duck

from pulselake.plans.checks import oracle_statements
from pulselake.plans.registry import all_queries

SF_DIR = "/root/testdata/sf0.001"

CHECKED = [
    "view_workout_summary",
    "view_sleep_combined",
    "correlation_rows",
    "monthly_flags",
    "vo2max_series",
    "heart_rate_zones",
    "cycling_sessions",
    "weekly_minutes",
    "current_streak",
    "walk_and_ride_totals",
    "interval_join_both_ends",
    "interval_join_start_only",
    "interval_overlap_join",
    "workout_routes",
    "route_points_sampled",
    "sleep_environment",
    "sleep_score",
    "summary_cards",
    "training_records",
    "period_deltas",
    "period_windows",
    "period_digest",
    "series_cards",
    "parsed_records",
    "parsed_route_points",
    "parsed_nights",
    "stored_row_counts",
    "json_payload",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(oracle_statements())


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows(spark, con, name):
    problem = differences(con, spark, name, all_queries()[name], oracle_statements()[name], SF_DIR)
    assert problem is None, problem
