"""Reading export files, tracks and night lists, and storing what was read."""

from __future__ import annotations

from dataclasses import replace
from datetime import date, datetime

import pytest
from conftest import frame, record, rows
from pyspark.sql import functions as F

from pulselake.functions.numeric import safe_double
from pulselake.operators.profile import profile_wide, upsert_profile
from pulselake.sinks.json_rows import write_json
from pulselake.sinks.store import drop_old_loads, open_tables, refresh, replace_source, save_profile
from pulselake.sources import export_xml, gpx, sleep_csv
from pulselake.sources.load import read_export, row_counts, top_record_types
from pulselake.tables import SCHEMAS

EXPORT = """<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [ <!ELEMENT Record (MetadataEntry*)> <!ATTLIST Record type CDATA #REQUIRED> ]>
<HealthData locale="en_US">
 <ExportDate value="2025-06-04 08:00:00 -0700"/>
 <Me HKCharacteristicTypeIdentifierDateOfBirth="1990-05-17" HKCharacteristicTypeIdentifierBiologicalSex="HKBiologicalSexMale"/>
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Tom&apos;s &amp; Ann &gt; all > none" unit="count"
   creationDate="2025-06-01 08:31:00 -0700" startDate="2025-06-01 08:00:00 -0700"
   endDate="2025-06-01 08:30:00 -0700" value="5000"/>
 <Record type='HKQuantityTypeIdentifierStepCount' sourceName='say "hi"' unit="count" startDate="2025-06-01 12:00:00 -0700" endDate="2025-06-01 12:30:00 -0700" value="3000">
  <MetadataEntry key="HKWasUserEntered" value="1"/>
 </Record>
 <Record
   type="HKQuantityTypeIdentifierHeartRate" unit="" startDate="2025-06-01 08:00:00 +0530" endDate="2025-06-01 08:01:00 +0530" value="not-a-number"></Record>
 <Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="30.5" durationUnit="min" startDate="2025-06-01 07:00:00 -0700" endDate="2025-06-01 07:30:00 -0700">
  <WorkoutEvent type="HKWorkoutEventTypePause"/>
  <WorkoutRoute sourceName="x"/>
 </Workout>
 <ActivitySummary dateComponents="2025-06-01" activeEnergyBurned="450" activeEnergyBurnedGoal="400" activeEnergyBurnedUnit="Cal" appleExerciseTime="35" appleExerciseTimeGoal="30" appleStandHours="12" appleStandHoursGoal="12"/>
</HealthData>
"""
GPX = """<?xml version="1.0"?>
<gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1" xmlns:x="http://example.com/ext">
 <trk><name>Morning</name><trkseg>
  <trkpt lat="47.6062" lon="-122.3321"><ele>10.5</ele><time>2025-06-01T14:00:00Z</time>
   <extensions><x:speed>3.5</x:speed><x:course>180</x:course><x:hAcc>5</x:hAcc><x:vAcc>3</x:vAcc></extensions></trkpt>
  <trkpt lat="47.6065" lon="-122.3325"><ele>11.0</ele><time>2025-06-01T07:00:10-07:00</time></trkpt>
 </trkseg><trkseg><trkpt lat="1" lon="2"/></trkseg></trk>
</gpx>
"""


def night_file() -> str:
    headers = [h for h, _, _ in sleep_csv.SLEEP_COLUMNS]
    values = dict.fromkeys(headers, "") | {
        "Start": "2025-06-01 22:30:00",
        "End": "2025-06-02 06:30:00",
        "Sleep Quality": "82%",
        "Regularity": "oops",
        "Deep (seconds)": "7200.0",
        "Steps": "123",
        "Weather temperature (°F)": "68.0",
        "Notes": '"two\nlines; one ""note"""',
    }
    return ";".join(headers) + "\n" + ";".join(values[h] for h in headers) + "\n"


@pytest.fixture
def export(tmp_path):
    folder = tmp_path / "exports" / "subject_id=7"
    (folder / "workout-routes").mkdir(parents=True)
    (folder / "export.xml").write_text(EXPORT, encoding="utf-8")
    (folder / "workout-routes" / "a.gpx").write_text(GPX)
    (folder / "workout-routes" / "bad.gpx").write_text("not valid xml!!!")
    (folder / "workout-routes" / "empty.gpx").write_text('<gpx version="1.1"><trk><trkseg></trkseg></trk></gpx>')
    nights = tmp_path / "nights" / "subject_id=7"
    nights.mkdir(parents=True)
    (nights / "sleepdata.csv").write_text(night_file(), encoding="utf-8")
    return tmp_path


def test_export_xml(spark, export):
    tags = export_xml.read_tags(spark, str(export / "exports"))
    records = {r["value"]: r for r in export_xml.parse_records(tags).collect()}
    assert set(records) == {5000.0, 3000.0, None}
    assert {r["subject_id"] for r in records.values()} == {7}
    assert {r["record_type"] for r in records.values()} == {"StepCount", "HeartRate"}
    assert records[5000.0]["source_name"] == "Tom's & Ann > all > none"
    assert records[3000.0]["source_name"] == 'say "hi"'
    assert records[5000.0]["start_date"] == datetime(2025, 6, 1, 8, 0)
    assert records[None]["start_date"] == datetime(2025, 6, 1, 8, 0)
    assert records[None]["unit"] is None and records[3000.0]["creation_date"] is None
    (run,) = export_xml.parse_workouts(tags).collect()
    assert (run["workout_activity_type"], run["duration"], run["total_distance"]) == (
        "HKWorkoutActivityTypeRunning",
        30.5,
        None,
    )
    (day,) = export_xml.parse_activity(tags).collect()
    assert (day["date_components"], day["apple_stand_hours_goal"]) == (date(2025, 6, 1), 12.0)
    assert export_xml.parse_activity(tags).columns == SCHEMAS["activity"].names
    assert rows(export_xml.parse_profile(tags)) == [("date_of_birth", "1990-05-17"), ("sex", "male")]


def test_large_file_is_split(spark, tmp_path):
    """One file is read by several tasks, and cuts between tasks lose or repeat nothing."""
    one = ' <Record type="HKQuantityTypeIdentifierStepCount" startDate="2025-06-01 08:00:00 -0700" value="{}"/>\n'
    (tmp_path / "export.xml").write_text("<HealthData>\n" + "".join(one.format(i) for i in range(20000)) + "</HealthData>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        tags = export_xml.read_tags(spark, str(tmp_path), subject_id=1)
        assert tags.rdd.getNumPartitions() > 10
        total = export_xml.parse_records(tags).agg(F.count("value"), F.sum("value"), F.countDistinct("value")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tuple(total) == (20000, sum(range(20000)), 20000)


def test_missing_export(spark, tmp_path):
    (tmp_path / "other.xml").write_text("<x/>")
    with pytest.raises(FileNotFoundError):
        export_xml.read_tags(spark, str(tmp_path))


@pytest.mark.parametrize(
    ("name", "expected"),
    [
        ("HKQuantityTypeIdentifierStepCount", "StepCount"),
        ("HKCategoryTypeIdentifierSleepAnalysis", "SleepAnalysis"),
        ("HKDataTypeSleepDurationGoal", "SleepDurationGoal"),
        ("HKWorkoutActivityTypeRunning", "HKWorkoutActivityTypeRunning"),
    ],
)
def test_short_type(spark, name, expected):
    assert spark.range(1).select(export_xml.short_type(F.lit(name))).first()[0] == expected


def test_safe_double(spark):
    given = ["3.14", "42", " 7 ", "-1e3", ".5", "5.", "not-a-number", "", None, "3.5f", "1d", "0x1p3", "-inf"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(safe_double(F.col("v"))).collect()]
    assert got == [3.14, 42.0, 7.0, -1000.0, 0.5, 5.0, None, None, None, None, None, None, float("-inf")]


@pytest.mark.parametrize("sex", ["HKBiologicalSexNotSet", None])
def test_unset_sex_gives_no_row(spark, sex):
    tag = "Me" + (f' HKCharacteristicTypeIdentifierBiologicalSex="{sex}"' if sex else ' x="y"') + "/>"
    assert export_xml.parse_profile(spark.createDataFrame([(1, tag)], "subject_id long, tag string")).count() == 0


def test_gpx(spark, export):
    points = gpx.read_routes(spark, str(export / "exports")).orderBy("recorded_at").collect()
    assert [p["gpx_file"] for p in points] == ["a.gpx"] * 3
    loose, first, second = points
    assert (loose["latitude"], loose["recorded_at"]) == (1.0, None)
    assert tuple(first)[2:] == ("Morning", 0, 0, datetime(2025, 6, 1, 14, 0), 47.6062, -122.3321, 10.5, 3.5, 180.0, 5.0, 3.0)
    assert [(p["segment"], p["point_no"]) for p in points] == [(1, 0), (0, 0), (0, 1)]
    assert (second["recorded_at"], second["speed"]) == (datetime(2025, 6, 1, 14, 0, 10), None)


def test_night_list(spark, export):
    nights = sleep_csv.read_nights(spark, str(export / "nights"))
    assert nights.columns == SCHEMAS["sleep"].names
    (n,) = nights.collect()
    assert (n["subject_id"], n["sleep_quality"], n["regularity"], n["deep_seconds"], n["steps"]) == (7, 0.82, None, 7200.0, 123)
    assert (n["start_time"], n["notes"]) == (datetime(2025, 6, 1, 22, 30), 'two\nlines; one "note"')


def test_typed_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("subject_id,key,value\n1,age,35\n")
    assert sleep_csv.read_typed_csv(spark, str(tmp_path / "p.csv"), SCHEMAS["profile"]).collect()[0]["value"] == "35"
    (tmp_path / "q.csv").write_text("subject_id,key,value\none,age,35\n")
    with pytest.raises(Exception, match="(?i)malformed|cannot"):
        sleep_csv.read_typed_csv(spark, str(tmp_path / "q.csv"), SCHEMAS["profile"]).collect()


def test_load_store_reload(spark, export, tmp_path):
    root = str(tmp_path / "store")
    known = frame(spark, "profile", [{"subject_id": 7, "key": "age", "value": "35"}, {"subject_id": 7, "key": "sex", "value": "female"}])
    loaded = read_export(spark, str(export / "exports"), str(export / "nights"), profile=known)
    expected = {"records": 3, "workouts": 1, "activity": 1, "route_points": 3, "sleep": 1, "profile": 3, "subjects": 1}
    staged = read_export(
        spark, str(export / "exports"), str(export / "nights"), profile=known, staging=str(tmp_path / "staging")
    )
    for tables in (loaded, loaded, staged):
        refresh(tables, root)
        assert {r["table"]: r["rows"] for r in row_counts(open_tables(spark, root)).collect()} == expected
    stored = open_tables(spark, root)
    assert rows(stored.profile) == [("age", "35"), ("date_of_birth", "1990-05-17"), ("sex", "male")]
    assert [tuple(r) for r in top_record_types(stored.records).collect()] == [("StepCount", 2), ("HeartRate", 1)]
    plan = stored.of_type("StepCount")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [record_type" in plan or "record_type" in plan.split("PartitionFilters")[1][:60]


def test_failed_load_leaves_the_old_one(spark, export, tmp_path):
    root = str(tmp_path / "store")
    loaded = read_export(spark, str(export / "exports"), str(export / "nights"))
    refresh(loaded, root)
    from dataclasses import replace

    broken = replace(loaded, sleep=loaded.sleep.withColumn("notes", F.raise_error(F.lit("broken night"))))
    with pytest.raises(Exception, match="broken night"):
        refresh(broken, root)
    assert open_tables(spark, root).sleep.count() == 1


def test_profile_upsert(spark):
    existing = frame(spark, "profile", [{"key": "age", "value": "34"}, {"key": "sex", "value": "male"}])
    updates = spark.createDataFrame(
        [(1, "age", "35", 1), (1, "age", "36", 2), (1, "sex", None, 1), (1, "height_in", "70", 1), (2, "age", "20", 1)],
        "subject_id long, key string, value string, version int",
    )
    merged = upsert_profile(existing, updates, order_by="version")
    assert rows(merged, "subject_id", "key", "value") == [
        (1, "age", "36"),
        (1, "height_in", "70"),
        (1, "sex", "male"),
        (2, "age", "20"),
    ]
    assert rows(profile_wide(merged), "age", "sex", "weight_lbs") == [("20", None, None), ("36", "male", None)]


def test_json_output(spark, seeded, tmp_path):
    from conftest import E, S
    from pulselake.sinks.json_rows import dashboard_datasets, json_rows

    datasets = dashboard_datasets(seeded, S, E, ["steps", "cycling"])
    got = {(r["dataset"], r["json"]) for r in json_rows(datasets).collect()}
    assert ("cycling", '{"date":"2025-06-03","distance":null,"duration_min":60.0,"calories":null}') in got
    assert ("steps", '{"date":"2025-06-02","steps":7000,"steps_7d_avg":7500}') in got
    write_json(datasets, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).groupBy("dataset").count().count() == 2


def test_nights_by_column_name(spark, tmp_path):
    """Three files: two column orders, and one that lacks a column; a file without a header fails."""
    files = {
        1: "Start;End;Awake (seconds);Deep (seconds)\n2025-01-01 22:00:00;2025-01-02 06:00:00;111;7200\n",
        2: "\ufeffEnd;Deep (seconds);Start;Awake (seconds)\n2025-01-02 06:10:00;7201;2025-01-01 22:10:00;112\n",
        3: "Deep (seconds);Start;End\n7203;2025-01-01 22:20:00;2025-01-02 06:20:00\n",
    }
    for subject, text in files.items():
        folder = tmp_path / "nights" / f"subject_id={subject}"
        folder.mkdir(parents=True)
        (folder / "sleepdata.csv").write_text(text, encoding="utf-8")
    got = {n.subject_id: n for n in sleep_csv.read_nights(spark, str(tmp_path / "nights")).collect()}
    assert {k: (n.awake_seconds, n.deep_seconds) for k, n in got.items()} == {1: (111.0, 7200.0), 2: (112.0, 7201.0), 3: (None, 7203.0)}
    assert [got[k].start_time.minute for k in (1, 2, 3)] == [0, 10, 20]
    other = tmp_path / "other" / "subject_id=4"
    other.mkdir(parents=True)
    (other / "a.csv").write_text("Anything;Else\n1;2\n")
    with pytest.raises(Exception, match="no header row"):
        sleep_csv.read_nights(spark, str(tmp_path / "other")).collect()


def test_paths_without_a_subject_fail(spark, tmp_path):
    (tmp_path / "sleepdata.csv").write_text(night_file(), encoding="utf-8")
    with pytest.raises(Exception, match="no subject_id="):
        sleep_csv.read_nights(spark, str(tmp_path)).collect()
    assert sleep_csv.read_nights(spark, str(tmp_path), subject_id=5).collect()[0].subject_id == 5


def test_track_times_in_any_session_zone(spark):
    """Two instants an hour apart that a Californian clock shows alike, and a text without a zone."""
    texts = ["2025-11-02T08:30:00Z", "2025-11-02T09:30:00Z", "2025-11-02T01:30:00.250-07:00", "2025-11-02 04:05:06", "never"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        rows = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [str(r[0]) for r in rows.select(gpx.utc_clock(F.col("t")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ["2025-11-02 08:30:00", "2025-11-02 09:30:00", "2025-11-02 08:30:00.25", "2025-11-02 04:05:06", "None"]


def _stored(spark, root):
    t = open_tables(spark, root)
    return {
        "records": sorted((r.subject_id, r.value) for r in t.records.collect()),
        "nights": sorted(r.subject_id for r in t.sleep.collect()),
        "profile": sorted((r.subject_id, r.key, r.value) for r in t.profile.collect()),
        "subjects": sorted(r.subject_id for r in t.subjects.collect()),
    }


def test_replacing_a_source_or_a_subject_leaves_the_rest(spark, nobody, tmp_path):
    root = str(tmp_path / "tables")
    assert open_tables(spark, root).records.collect() == []
    heart = lambda subject, value: record("HeartRate", "06-01 08:00", value=value) | {"subject_id": subject}
    night = lambda subject: {"subject_id": subject, "start_time": datetime(2025, 6, 1, 22)}
    made = lambda **t: replace(nobody, **{k: frame(spark, k, v) for k, v in t.items()})
    refresh(
        made(records=[heart(1, 60.0), heart(2, 70.0)], sleep=[night(1), night(2)], subjects=[{"subject_id": 1}, {"subject_id": 2}]), root
    )
    replace_source(made(records=[heart(1, 61.0), heart(1, 62.0)], subjects=[{"subject_id": 1}]), root, "phone", [1])
    assert _stored(spark, root)["records"] == [(1, 61.0), (1, 62.0), (2, 70.0)]
    replace_source(made(sleep=[night(3)], subjects=[{"subject_id": 3}]), root, "nights")
    save_profile(spark, root, frame(spark, "profile", [{"subject_id": 2, "key": "age", "value": "40"}]))
    want = {"records": [(1, 61.0), (1, 62.0), (2, 70.0)], "nights": [3], "profile": [(2, "age", "40")], "subjects": [1, 2, 3]}
    assert _stored(spark, root) == want
    dropped = drop_old_loads(spark, root)
    assert {f.rsplit("/", 1)[1] for f in dropped} >= {"sleep", "profile"} and _stored(spark, root) == want
    refresh(made(records=[heart(9, 50.0)], subjects=[{"subject_id": 9}]), root)
    assert _stored(spark, root) == {"records": [(9, 50.0)], "nights": [], "profile": [], "subjects": [9]}
