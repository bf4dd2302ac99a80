"""Joining points in time, or intervals, to intervals: bucketed equi-joins instead of nested loops.

Buckets come in widths of 1, 16, 256, ... hours. An interval lies in at most FAN + 1 buckets of the narrowest width that
allows it, whether it lasts a minute or a century. A point looks up one bucket of each width that some interval has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.calendar import hour_bucket

#: A busy (subject, bucket) of records is spread over this many sub-keys; intervals are repeated once per sub-key.
SALTS = 4
#: Each width is so many of the one before, as a power of two; and the widths, the last of 16**7 hours, over 30,000 years.
FAN_BITS = 4
WIDTHS = 8
#: Rows of a side that meet under one key; a busier cell is cut into parts.
PART_ROWS = 4_096


def _width(first: Column, last: Column) -> Column:
    """The narrowest width at which the hours from first to last lie in at most FAN + 1 buckets."""
    fitting = F.lit(WIDTHS - 1)
    for k in reversed(range(WIDTHS - 1)):
        shift = FAN_BITS * k
        fitting = F.when(F.shiftright(last, shift) - F.shiftright(first, shift) <= 1 << FAN_BITS, k).otherwise(fitting)
    return fitting


def _bucket(hour: Column, width: Column) -> Column:
    """The bucket of an hour number at a width that differs by row."""
    found = F.shiftright(hour, FAN_BITS * (WIDTHS - 1))
    for k in reversed(range(WIDTHS - 1)):
        found = F.when(width == k, F.shiftright(hour, FAN_BITS * k)).otherwise(found)
    return found


def _placed(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals with ``_width``, ``_from`` and ``_to`` (hours). Reversed or open ones can match nothing and are dropped."""
    hours = intervals.where(F.col(end) >= F.col(start)).withColumns({"_from": hour_bucket(F.col(start)), "_to": hour_bucket(F.col(end))})
    return hours.withColumn("_width", _width(F.col("_from"), F.col("_to")))


def _buckets(rows: DataFrame, width: str) -> DataFrame:
    """One row per bucket of the width in column ``width``."""
    at = F.col(width)
    return rows.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col("_from"), at), _bucket(F.col("_to"), at))))


def _numbered(bucket: Column, width: Column) -> Column:
    """One number for a bucket and its width."""
    return bucket * WIDTHS + width


def _at_widths(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` once for each ``_width`` that some interval has, at most WIDTHS times.

    Few rows are broadcast, whatever the size of the tables: the widths that occur.
    """
    every = rows.withColumn("_width", F.explode(F.array(*[F.lit(k) for k in range(WIDTHS)])))
    return every.join(F.broadcast(placed.select("_width").distinct()), "_width", "left_semi")


def _salt(salts: int) -> Column:
    """Sub-key of a record. Never NULL, and declared so: Spark then adds no not-null filter computing it twice."""
    spread = F.pmod(F.xxhash64("start_date", "end_date", "value"), F.lit(salts))
    return F.coalesce(spread.cast("int"), F.lit(0))


def records_within(
    workouts: DataFrame,
    records: DataFrame,
    *,
    both_ends: bool,
    salts: int = SALTS,
) -> DataFrame:
    """Every (workout row, record row) pair where the record lies inside the workout.

    ``both_ends`` asks for the whole record inside the workout; otherwise its start decides. Bounds are inclusive.
    The result has the workout columns plus ``record_type``, ``record_start`` and ``value``. A workout has one width
    and a record one bucket of it, so no pair appears twice. The equi-key is (subject, bucket, salt), the bucket's number
    telling its width: a subject or hour with a large share of all records is spread over many tasks, and runs of equal
    records (same salt) are left to AQE's skew split, which cuts by bytes, not by key. Neither side is broadcast unless
    Spark's size check allows.
    """
    placed = _placed(workouts, "start_date", "end_date")
    number = _numbered(F.col("_bucket"), F.col("_width"))
    left = _buckets(placed, "_width").withColumn("_bucket", number).withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    points = records.select(
        F.col("subject_id"),
        _salt(salts).alias("_salt"),
        F.col("record_type"),
        F.col("start_date").alias("record_start"),
        F.col("end_date").alias("record_end"),
        F.col("value"),
        hour_bucket(F.col("start_date")).alias("_hour"),
    )
    bucket = _numbered(_bucket(F.col("_hour"), F.col("_width")), F.col("_width"))
    right = _at_widths(points, placed).withColumn("_bucket", bucket).drop("_hour", "_width")
    inside = F.col("record_start").between(F.col("start_date"), F.col("end_date"))
    if both_ends:
        inside &= F.col("record_end").between(F.col("start_date"), F.col("end_date"))
    return (
        left.join(right, ["subject_id", "_bucket", "_salt"], "inner")
        .where(inside)
        .drop("_from", "_to", "_width", "_bucket", "_salt", "record_end")
    )


_CELL = ["subject_id", "_shared", "_bucket"]


def _cells(placed: DataFrame) -> DataFrame:
    """Buckets of each interval's own width and of all wider ones, at which it may meet longer intervals."""
    shared = placed.withColumn("_shared", F.explode(F.sequence("_width", F.lit(WIDTHS - 1))))
    return _buckets(shared, "_shared")


def _parts(left: DataFrame, right: DataFrame) -> DataFrame:
    """The cells where a side has more than PART_ROWS rows, and how many parts each side is cut into there."""
    sides = left.select(*_CELL, F.lit(1).alias("_l")).unionByName(right.select(*_CELL, F.lit(0).alias("_l")))
    counts = sides.groupBy(*_CELL).agg(F.sum("_l").alias("_left"), F.sum(1 - F.col("_l")).alias("_right"))
    cut = {name: F.greatest(F.ceil(F.col(name) / PART_ROWS), F.lit(1)).cast("int") for name in ("_left", "_right")}
    return counts.where(F.greatest("_left", "_right") > PART_ROWS).withColumns(cut)


def _spread(cells: DataFrame, busy: DataFrame, own: str, other: str) -> DataFrame:
    """Rows of a busy cell in one part of their own side, repeated over the parts of the other."""
    sized = cells.join(busy, _CELL, "left")
    part = F.pmod(F.xxhash64(*cells.columns), F.coalesce(F.col(own), F.lit(1))).cast("int")
    repeats = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
    return sized.withColumn(f"{own}_at", part).withColumn(f"{other}_at", repeats).drop(own, other)


def overlapping(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Every pair of intervals of one subject sharing at least an instant (inclusive bounds), each pair once.

    Two intervals meet at the wider of their widths, in the first bucket that they share there. Cells, buckets of a
    subject, are counted on both sides; busy ones are cut into parts, and each part of one side meets each of the other
    under a key of its own. Only busy cells are repeated.
    """
    (ls, le), (rs, re) = left_span, right_span
    a, b = _placed(left, ls, le), _placed(right, rs, re)
    of_a, of_b = _cells(a), _cells(b)
    busy = _parts(of_a, of_b)
    spread_a = _spread(of_a, busy, "_left", "_right")
    spread_b = _spread(of_b, busy, "_right", "_left").withColumnsRenamed({"_from": "_from_b", "_to": "_to_b", "_width": "_width_b"})
    meet = F.greatest(_bucket(F.col("_from"), F.col("_shared")), _bucket(F.col("_from_b"), F.col("_shared")))
    return (
        spread_a.join(spread_b, [*_CELL, "_left_at", "_right_at"], "inner")
        .where((F.col("_shared") == F.greatest("_width", "_width_b")) & (F.col("_bucket") == meet))
        .where((F.col(rs) <= F.col(le)) & (F.col(re) >= F.col(ls)))
        .drop("_shared", "_bucket", "_left_at", "_right_at", "_from", "_to", "_width", "_from_b", "_to_b", "_width_b")
    )
