"""Interval joins, ordered calculations, percentiles and rounding against plain Python on small data."""

from __future__ import annotations

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest
from conftest import frame
from pyspark.sql import functions as F

from pulselake.functions import ordered
from pulselake.functions.numeric import half_even, sql_round
from pulselake.operators import intervals, period, routes, sleep
from pulselake.operators.sleep import percentile_bounds

T0 = datetime(2025, 6, 1)


def _intervals_and_records(seed: int):
    """A busy subject with copies, open and reversed intervals, and records on the exact bounds."""
    rng = random.Random(seed)
    spans = []
    for i in range(60):
        start = T0 + timedelta(minutes=rng.randrange(3000))
        end = start + timedelta(minutes=rng.choice([0, 5, 60, 61, 500]))
        spans.append({"subject_id": rng.choice([1, 1, 1, 2]), "start_date": start, "end_date": end, "duration": float(i)})
    spans += [dict(spans[0]), {"subject_id": 1, "start_date": T0, "end_date": None, "duration": -1.0}]
    spans.append({"subject_id": 1, "start_date": T0 + timedelta(hours=9), "end_date": T0, "duration": -2.0})
    records = []
    for i in range(400):
        start = T0 + timedelta(minutes=rng.randrange(3000))
        end = None if i % 50 == 0 else start + timedelta(minutes=rng.choice([0, 1, 30]))
        records.append({"subject_id": rng.choice([1, 1, 2, 3]), "record_type": "x", "start_date": start, "end_date": end, "value": float(i)})
    records += [dict(records[3]) for _ in range(200)]
    records += [
        {"subject_id": 1, "record_type": "x", "start_date": s["start_date"], "end_date": s["end_date"], "value": 0.5}
        for s in spans[:10]
    ]
    return spans, records


@pytest.mark.parametrize("both_ends", [True, False])
@pytest.mark.parametrize("salts", [1, 4])
def test_records_within(spark, both_ends, salts):
    spans, records = _intervals_and_records(5)
    got = intervals.records_within(
        frame(spark, "workouts", spans), frame(spark, "records", records), both_ends=both_ends, salts=salts
    )
    pairs = sorted((r["duration"], r["value"], r["record_start"]) for r in got.collect())
    expected = sorted(
        (w["duration"], r["value"], r["start_date"])
        for w in spans
        for r in records
        if w["subject_id"] == r["subject_id"]
        and w["end_date"] is not None
        and w["start_date"] <= r["start_date"] <= w["end_date"]
        and (not both_ends or (r["end_date"] is not None and w["start_date"] <= r["end_date"] <= w["end_date"]))
    )
    assert pairs == expected and len(pairs) > 300


def test_overlapping(spark):
    spans, _ = _intervals_and_records(8)
    left = frame(spark, "workouts", spans).selectExpr("subject_id", "start_date as a", "end_date as b", "duration as x")
    right = frame(spark, "workouts", spans[:25]).selectExpr("subject_id", "start_date as c", "end_date as d", "duration as y")
    got = sorted((r["x"], r["y"]) for r in intervals.overlapping(left, right, ("a", "b"), ("c", "d")).collect())
    ok = [s for s in spans if s["end_date"] is not None and s["end_date"] >= s["start_date"]]
    expected = sorted(
        (p["duration"], q["duration"])
        for p in ok
        for q in (s for s in spans[:25] if s["end_date"] >= s["start_date"])
        if p["subject_id"] == q["subject_id"] and q["start_date"] <= p["end_date"] and q["end_date"] >= p["start_date"]
    )
    assert got == expected and len(got) > 50


def test_buckets_of_different_widths_keep_apart(spark):
    """All widths have a bucket 0: a minute, a day and a year from 1970 on meet a record of its first hour once each."""
    starts, ends = "timestamp_ntz '1970-01-01 00:10:00'", ("00:11:00", "23:59:00", "23:59:00")
    days = ("1970-01-01", "1970-01-02", "1970-12-31")
    workouts = spark.sql(" union all ".join(f"select 1L subject_id, {starts} start_date, timestamp_ntz '{d} {e}' end_date, {k} w" for k, (d, e) in enumerate(zip(days, ends, strict=True))))
    records = spark.sql(f"select 1L subject_id, 'HeartRate' record_type, {starts} start_date, {starts} end_date, 1.0D value")
    placed = intervals._placed(workouts, "start_date", "end_date")
    assert sorted(r["_width"] for r in placed.collect()) == [0, 1, 3]
    assert intervals._at_widths(records, placed).count() == 3
    got = intervals.records_within(workouts, records, both_ends=True).collect()
    assert sorted(r["w"] for r in got) == [0, 1, 2]


def test_long_intervals_cost_few_rows(spark):
    """A minute and a century, before 1970 too: few buckets each, and the same pairs as a plain search."""
    spans = [(T0, T0 + timedelta(minutes=1)), (T0 - timedelta(days=36_500), T0 + timedelta(days=20)), (T0, T0 + timedelta(days=36_500)), (T0 - timedelta(days=30_000), T0 - timedelta(days=25_000)), (T0, T0 + timedelta(hours=17, minutes=30))]
    workouts = frame(spark, "workouts", [{"subject_id": 1, "start_date": a, "end_date": b, "duration": float(k)} for k, (a, b) in enumerate(spans)])
    placed = intervals._buckets(intervals._placed(workouts, "start_date", "end_date"), "_width")
    assert placed.groupBy("duration").count().agg(F.max("count")).first()[0] <= 17
    points = [T0, T0 + timedelta(seconds=30), T0 + timedelta(days=30_000), T0 - timedelta(days=28_000), T0 - timedelta(days=36_500), T0 + timedelta(days=40_000), T0 + timedelta(hours=17)]
    records = frame(spark, "records", [{"subject_id": 1, "record_type": "x", "start_date": p, "end_date": p, "value": float(k)} for k, p in enumerate(points)])
    got = sorted((r["duration"], r["value"]) for r in intervals.records_within(workouts, records, both_ends=True).collect())
    assert got == sorted((float(k), float(n)) for k, (a, b) in enumerate(spans) for n, p in enumerate(points) if a <= p <= b)
    left, right = workouts.selectExpr("subject_id", "start_date as a", "end_date as b", "duration as x"), workouts.selectExpr("subject_id", "start_date as c", "end_date as d", "duration as y")
    got = sorted((r["x"], r["y"]) for r in intervals.overlapping(left, right, ("a", "b"), ("c", "d")).collect())
    assert got == sorted((float(i), float(j)) for i, p in enumerate(spans) for j, q in enumerate(spans) if p[0] <= q[1] and q[0] <= p[1])
    nobody = intervals.overlapping(left.where("x < 0"), right, ("a", "b"), ("c", "d"))
    assert nobody.count() == 0 and intervals.records_within(workouts.where("duration < 0"), records, both_ends=True).count() == 0


def test_a_busy_hour_is_spread_over_parts(spark, monkeypatch):
    """3,000 and 400 intervals of one subject in one hour: every pair once, in many parts of both sides."""
    monkeypatch.setattr(intervals, "PART_ROWS", 375)
    rows = spark.range(3_000).select(F.lit(1).cast("long").alias("subject_id"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id") % 900)).cast("timestamp_ntz").alias("a"), F.col("id").alias("x"))
    left = rows.withColumn("b", F.col("a") + F.expr("interval 30 minutes"))
    right = left.where("x < 400").selectExpr("subject_id", "a as c", "b as d", "x as y")
    cells, others = (intervals._cells(intervals._placed(d, *c)) for d, c in ((left, "ab"), (right, "cd")))
    spread = intervals._spread(cells, intervals._parts(cells, others), "_left", "_right").where("_shared = 0")
    sizes = [r["count"] for r in spread.groupBy("_bucket", "_left_at", "_right_at").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 6_000 and max(sizes) < 600
    pairs = intervals.overlapping(left, right, ("a", "b"), ("c", "d"))
    assert pairs.count() == 1_200_000 and pairs.select("x", "y").distinct().count() == 1_200_000


def test_trailing_over_rows_matches_a_plain_scan(spark, monkeypatch):
    """Blocks far smaller than the data, many rows per slice, and a key holding most rows."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 10)
    rng = random.Random(3)
    data = [(1 if i % 4 else 2, rng.randrange(12), i, float(rng.randrange(100))) for i in range(300)]
    df = spark.createDataFrame(data, "k long, slice long, tie long, v double")
    placed = ordered.in_blocks(
        ordered.with_running_total(df, ["k"], F.col("slice"), [F.col("tie")]), back=6, block=10
    )
    assert placed.groupBy("k", "_block").count().agg(F.max("count")).first()[0] <= 16
    got = ordered.trailing_over_rows(df, ["k"], F.col("slice"), [F.col("tie")], 7, {"m": F.sum("v")})
    found = {(r["k"], r["tie"]): (r["pos"], r["m"]) for r in got.collect()}
    assert len(found) == len(data) == got.count()
    for key in (1, 2):
        series = sorted((d for d in data if d[0] == key), key=lambda d: (d[1], d[2]))
        for i, d in enumerate(series):
            assert found[(key, d[2])] == (i + 1, sum(x[3] for x in series[max(0, i - 6) : i + 1]))


def test_running_total_with_weights_and_missing_slices(spark):
    df = spark.createDataFrame([(1, 5, 1, 3), (1, 2, 2, 4), (1, None, 3, 10)], "k int, s int, o int, w int")
    got = ordered.with_running_total(df, ["k"], F.col("s"), [F.col("o")], weight=F.col("w"))
    assert sorted((r["o"], r["pos"], r["total"]) for r in got.collect()) == [(1, 7, 17), (2, 4, 17), (3, 17, 17)]


def test_percentile_bounds(spark):
    rng = random.Random(1)
    data = [(k, rng.choice([68.3, rng.uniform(-5, 90)]), float(rng.randrange(5))) for k in (1, 1, 1, 2) for _ in range(40)]
    data.append((3, 1.5, 2.5))
    df = spark.createDataFrame(data, "k int, a double, b double")
    got = {r["k"]: r for r in percentile_bounds(df, ["k"], {"a": "a", "b": "b"}, (0.05, 0.95)).collect()}

    def at(values, share):
        values = sorted(values)
        place = (len(values) - 1) * share
        low = int(place)
        high = low if place == low else low + 1
        return values[low] + (values[high] - values[low]) * (place - low)

    for k in (1, 2, 3):
        for name, column in (("a", 1), ("b", 2)):
            values = [d[column] for d in data if d[0] == k]
            assert got[k][f"{name}_lo"] == pytest.approx(at(values, 0.05), abs=1e-12)
            assert got[k][f"{name}_hi"] == pytest.approx(at(values, 0.95), abs=1e-12)


def test_half_even_is_exact(spark):
    rng = random.Random(2)
    values = [k / 1000 for k in range(-3000, 3000, 5)] + [rng.uniform(-1000, 1000) for _ in range(2000)]
    values += [2.5, 3.5, -2.5, 0.125, 2.675, 1.005, 0.285, 1e12 + 0.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2):
        for v, got in df.select("v", half_even(F.col("v"), digits)).collect():
            assert got == round(v, digits), (v, digits)


def test_sql_round(spark):
    cases = [(1.005, 2, 1.0), (0.285, 2, 0.28), (2.5, 0, 3.0), (-2.5, 0, -3.0), (6.25, 1, 6.3)]
    for v, digits, expected in cases:
        assert spark.range(1).select(sql_round(F.lit(v), digits)).first()[0] == expected


def test_resolve_period():
    today = date(2025, 6, 10)
    assert period.resolve_period("all", "2025-01-01", "2025-02-01", today) == (date(2025, 1, 1), date(2025, 2, 1))
    assert period.resolve_period("all", "2025-01-01", None, today) == (date(2025, 1, 1), today)
    assert period.resolve_period("last-week", None, "2025-02-01", today) == (date(2025, 6, 3), today)
    assert period.resolve_period("all", None, None, today)[0] == today - timedelta(days=3650)
    with pytest.raises(ValueError, match="names no period"):
        period.resolve_period("last-decade", None, None, today)
    assert period.prior_period(date(2025, 6, 1), date(2025, 6, 3)) == (date(2025, 5, 30), date(2025, 5, 31))
    assert period.prior_period(today, today) == (date(2025, 6, 9), date(2025, 6, 9))


def test_route_sampling_and_gain(spark, nobody):
    """103 points, of which only 40 lie in the range: the step comes from those, the points from all."""
    from dataclasses import replace

    start = datetime(2025, 6, 1, 0, 0)
    points = [
        {
            "gpx_file": "walk.gpx",
            "recorded_at": start + timedelta(minutes=30 * i),
            "latitude": 47 + i / 1000,
            "longitude": -122.0,
            "elevation": None if i % 10 == 9 else float((i * 7) % 13),
            "speed": 0.0 if i % 2 else 1.5,
        }
        for i in range(103)
    ]
    tables = replace(nobody, route_points=frame(spark, "route_points", points))
    day = date(2025, 6, 1)
    in_range = sum(p["recorded_at"].date() == day for p in points)
    sampled = routes.sampled_points(tables, day, day, max_pts=12)
    step = max(1, in_range // 12)
    kept = [i for i in range(103) if i == 0 or i == 102 or (i + 1) % step == 0]
    assert sorted(r["pos"] for r in sampled.collect()) == [i + 1 for i in kept]
    known = [points[i]["elevation"] for i in kept if points[i]["elevation"] is not None]
    gain = sum(max(0.0, b - a) for a, b in zip(known, known[1:], strict=False))
    assert routes.elevation_gain(sampled).first()["ele_gain_ft"] == round(gain * 3.28084, 0)
    profile = routes.elevation_profile(sampled)
    assert profile.count() == len(known)
    assert {r["speed_mph"] for r in profile.collect()} <= {None, round(1.5 * 2.23694, 1)}
    miles = routes.route_distance_table(tables, day, day).first()["miles"]
    assert miles == pytest.approx(0.102 * 3959 * 3.141592653589793 / 180, abs=0.01)


def test_points_of_one_time_stand_as_in_the_file(spark, nobody):
    """Two segments without any time, and equal times: no zigzag by latitude."""
    places = [47.3, 47.1, 47.2, 47.0]
    made = lambda times: replace(
        nobody,
        route_points=frame(
            spark,
            "route_points",
            [
                {"gpx_file": "a.gpx", "segment": k // 2, "point_no": k % 2, "recorded_at": t, "latitude": places[k], "longitude": -122.0}
                for k, t in enumerate(times)
            ],
        ),
    )
    day = datetime(2025, 6, 1, 8)
    listed = spark.createDataFrame([(1, "a.gpx")], "subject_id long, gpx_file string")
    for times in ([day] * 4, [None] * 4):
        points = routes.ordered_points(made(times), listed).orderBy("pos").collect()
        assert [p["latitude"] for p in points] == places


def test_every_track_of_a_subject_counts(spark, nobody):
    """Sixty tracks: all have a distance unless a number is asked for."""
    start = datetime(2025, 6, 1, 0, 0)
    points = [
        {"gpx_file": f"{k:02}.gpx", "recorded_at": start + timedelta(minutes=10 * k + i), "latitude": 47 + i / 1000, "longitude": -122.0}
        for k in range(60)
        for i in range(2)
    ]
    tables = replace(nobody, route_points=frame(spark, "route_points", points))
    day = date(2025, 6, 1)
    assert {r["gpx_file"] for r in routes.route_distance_table(tables, day, day).collect()} == {f"{k:02}.gpx" for k in range(60)}
    assert {r["gpx_file"] for r in routes.recent_routes(tables, day, day, limit=2).collect()} == {"59.gpx", "58.gpx"}


def test_route_label(spark):
    made = spark.createDataFrame(
        [(1, "a.gpx", date(2025, 3, 5), "Running", 8.0, 2.45), (1, "b.gpx", None, None, None, None)],
        "subject_id long, gpx_file string, date date, workout_type string, duration_min double, distance_mi double",
    )
    got = {r["gpx_file"]: (r["label"], r["pace"]) for r in routes.route_labels(made).collect()}
    assert got == {"a.gpx": ("Mar 05 — Running — (2.5 mi, 8 min)", "3:16"), "b.gpx": ("b", None)}


def test_score_parts(spark):
    """Missing parts count 0; long and short nights lose marks."""
    rows = [
        {"time_asleep_seconds": 7.5 * 3600, "time_in_bed_seconds": 8 * 3600.0},
        {"time_asleep_seconds": 10 * 3600.0, "time_in_bed_seconds": 0.0, "time_before_sleep_seconds": 6000.0},
        {"time_asleep_seconds": 3.5 * 3600, "regularity": 1.0, "time_before_sleep_seconds": 0.0},
    ]
    df = frame(spark, "sleep", rows).select("time_asleep_seconds", sleep.score_expression().alias("score"))
    got = {r[0] / 3600: r[1] for r in df.collect()}
    assert got == {7.5: round(40 + 7.5 / 8 * 25), 10.0: 20, 3.5: 20 + 15 + 10}
