"""Stored tables: full refresh, replacement of one source or some subjects, and removal of what no load needs.

A load is a set of entries, each naming a table, a folder with rows of it, and the subjects whose rows there no longer
count. Folders are never changed. A new load writes folders only for what it brings and takes over the entries of the
rest, so loading the nights leaves the phone's data alone, and loading one subject rewrites no other. Entries of a load
are published together, last, in one file: readers see the last load that finished, never a half-written one.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timezone
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pulselake.tables import SCHEMAS, Tables, empty_tables

_ENTRIES = "load string, table string, folder string, without array<bigint>, loaded_at timestamp"

#: The tables that come from each source; every load adds its subjects to those known.
SOURCES = {
    "phone": ("records", "workouts", "activity", "route_points"),
    "nights": ("sleep",),
    "profile": ("profile",),
}

# Sort order inside files, so row groups can be skipped by subject and time.
_SORT = {
    "records": ["record_type", "subject_id", "start_date"],
    "workouts": ["subject_id", "start_date"],
    "activity": ["subject_id", "date_components"],
    "route_points": ["subject_id", "gpx_file", "recorded_at"],
    "sleep": ["subject_id", "start_time"],
    "profile": ["subject_id", "key"],
    "subjects": ["subject_id"],
}


def _write(frame: DataFrame, name: str, folder: str) -> None:
    """Records are partitioned by type; the rebalance hint has AQE split large types and merge small ones."""
    rows = frame.select(*SCHEMAS[name].names)
    rows = rows.hint("rebalance", "record_type") if name == "records" else rows.hint("rebalance")
    writer = rows.sortWithinPartitions(*_SORT[name]).write.mode("errorifexists")
    if name == "records":
        writer = writer.partitionBy("record_type")
    writer.parquet(folder)


def _entries(spark: SparkSession, root: str) -> list[Row]:
    """The entries of the latest finished load: a few for each table."""
    try:
        known = spark.read.schema(_ENTRIES).parquet(f"{root}/loads")
    except Exception as error:  # no load yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    latest = known.agg(F.max(F.struct("loaded_at", "load")).alias("last")).first()["last"]
    return known.where(F.col("load") == latest["load"]).collect() if latest else []


def _publish(spark: SparkSession, root: str, load: str, entries: Iterable[tuple]) -> None:
    now = datetime.now(timezone.utc)
    rows = spark.createDataFrame([(load, *e, now) for e in entries], _ENTRIES)
    rows.coalesce(1).write.mode("append").parquet(f"{root}/loads")


def _load(t: Tables, root: str, names: Sequence[str], kept: Iterable[tuple]) -> str:
    spark = t.records.sparkSession
    load = f"load-{uuid4().hex}"
    folders = {name: f"{root}/{load}/{name}" for name in names}
    for name, folder in folders.items():
        _write(getattr(t, name), name, folder)
    _publish(spark, root, load, [*kept, *((name, folder, []) for name, folder in folders.items())])
    return f"{root}/{load}"


def refresh(t: Tables, root: str) -> str:
    """Write all tables as a new load under ``root`` and return its folder; nothing of earlier loads stays current."""
    return _load(t, root, list(SCHEMAS), [])


def replace_source(t: Tables, root: str, source: str, subject_ids: Sequence[int] | None = None) -> str:
    """Replace the tables of one of SOURCES, for all subjects or for ``subject_ids`` only; all else stays current.

    With ``subject_ids`` the rows of ``t`` are expected to be theirs; the stored rows of these subjects no longer
    count, those of others are neither read nor written.
    """
    names = SOURCES[source]
    kept = []
    for e in _entries(t.records.sparkSession, root):
        if e["table"] not in names:
            kept.append((e["table"], e["folder"], list(e["without"])))
        elif subject_ids is not None:
            kept.append((e["table"], e["folder"], sorted({*e["without"], *subject_ids})))
    return _load(t, root, [*names, "subjects"], kept)


def save_profile(spark: SparkSession, root: str, profile: DataFrame) -> str:
    """Make ``profile`` (all subjects) the current one; writes that table alone."""
    load = f"load-{uuid4().hex}"
    kept = [(e["table"], e["folder"], list(e["without"])) for e in _entries(spark, root) if e["table"] != "profile"]
    _write(profile, "profile", f"{root}/{load}/profile")
    _publish(spark, root, load, [*kept, ("profile", f"{root}/{load}/profile", [])])
    return f"{root}/{load}"


def open_tables(spark: SparkSession, root: str) -> Tables:
    """The tables of the latest finished load; a root without a load gives empty ones."""
    entries = _entries(spark, root)
    tables = {name: getattr(empty_tables(spark), name) for name in SCHEMAS}
    for name in SCHEMAS:
        parts = []
        for e in entries:
            if e["table"] == name:
                rows = spark.read.schema(SCHEMAS[name]).parquet(e["folder"]).select(*SCHEMAS[name].names)
                parts.append(rows.where(~F.col("subject_id").isin(*e["without"])) if e["without"] else rows)
        if parts:
            tables[name] = reduce(DataFrame.unionByName, parts)
    return Tables(**tables | {"subjects": tables["subjects"].distinct()})


def drop_old_loads(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders that the latest load does not name, and return them. Run it when no older reader is left."""
    current = {e["folder"] for e in _entries(spark, root)}
    past = spark.read.schema(_ENTRIES).parquet(f"{root}/loads").select("folder").distinct().collect()
    dropped = sorted(r["folder"] for r in past if r["folder"] not in current)
    for folder in dropped:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return dropped
