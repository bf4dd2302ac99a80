"""What the physical plans must and must not contain, with broadcasting off as for large tables."""

from __future__ import annotations

import re

import pytest

from pulselake.operators import daily, routes, sleep, summary, views, workouts
from pulselake.plans.driver_tables import END, START, derive_tables
from pulselake.plans.registry import ON_TABLES
from pulselake.sinks.store import open_tables, refresh

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    refresh(derive_tables(spark, SF_DIR), root)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield open_tables(spark, root)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in ON_TABLES if n != "stored_row_counts"])
def test_no_nested_loops_and_no_single_task_windows(stored, name):
    plan = plan_of(ON_TABLES[name](stored))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    if name not in ("load_row_counts", "load_top_types"):
        assert "SinglePartition" not in plan
    assert "PythonUDF" not in plan and "InPandas" not in plan


def test_filters_reach_the_scan(stored):
    text = plan_of(daily.heart_rate_series(stored, START, END))
    assert re.search(r"PartitionFilters: \[record_type#\d+ IN", text)
    assert "GreaterThanOrEqual(start_date,2024-02-01T00:00)" in text
    assert "ReadSchema: struct<subject_id:bigint,start_date:timestamp_ntz,value:double>" in text


def test_daily_metrics_shuffle_once(stored):
    assert plan_of(daily.heart_rate_series(stored, START, END)).count("Exchange hashpartitioning") == 1
    assert plan_of(views.daily_summary(stored)).count("Exchange hashpartitioning") == 2


def test_raw_rows_are_windowed_by_slice(stored):
    """Windows over raw nights and points are keyed by slice or block as well; only per-slice totals are not."""
    for df, key in (
        (sleep.efficiency_series(stored, START, END), "subject_id"),
        (routes.route_distance_table(stored, START, END), "gpx_file"),
    ):
        keyed_by = re.findall(r"Window \[(.*?)\], \[(.*?)\]", plan_of(df))
        assert keyed_by
        for computed, keys in keyed_by:
            if "start_time" in computed or "latitude" in computed or "metric" in computed:
                assert "_slice" in keys or "_block" in keys, (key, computed, keys)


def test_interval_join_keys(stored):
    plan = plan_of(workouts.running_pace(stored, START, END))
    assert re.search(r"SortMergeJoin \[subject_id#\d+L, _bucket#\d+L, _salt#\d+\]", plan)


def test_summary_scans_each_table_few_times(stored):
    """26 scalar questions need no 26 scans."""
    assert plan_of(summary.summary_cards(stored, START, END)).count("Scan parquet") <= 14
