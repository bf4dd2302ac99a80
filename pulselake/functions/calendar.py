"""Date arithmetic on wall-clock (TIMESTAMP_NTZ) columns, independent of the session time zone."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed labels, Sunday first.
DAY_NAMES = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]


def day(ts: Column) -> Column:
    return ts.cast("date")


def date_lit(d: date) -> Column:
    return F.lit(d.isoformat()).cast("date")


def ts_lit(d: date) -> Column:
    """Midnight of a day as TIMESTAMP_NTZ, so comparisons never cast the column side."""
    return F.lit(f"{d.isoformat()} 00:00:00").cast("timestamp_ntz")


def ts_between_days(ts: Column, s: date, e: date) -> Column:
    """The day of ``ts`` lies in [s, e], as a bare range on ``ts``: it reaches the parquet scan."""
    return (ts >= ts_lit(s)) & (ts < ts_lit(e + timedelta(days=1)))


def between_days(d: Column, s: date, e: date) -> Column:
    return d.between(date_lit(s), date_lit(e))


def week_start(d: Column) -> Column:
    """Monday of the week."""
    return F.trunc(d, "week")


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def day_of_week(d: Column) -> Column:
    """Sunday = 0 .. Saturday = 6."""
    return (F.dayofweek(d) - 1).cast("bigint")


def day_name(dow: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), (dow + 1).cast("int"))


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds from start to end with fractions, as DOUBLE."""
    return (end - start).cast("interval second").cast("decimal(20,6)").cast("double")


def hour_bucket(ts: Column) -> Column:
    """Hours since 1970-01-01 00:00 wall clock."""
    return F.datediff(day(ts), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(ts)


def day_spine(s: date, e: date) -> Column:
    """Array of every day in [s, e]; explode it next to a subject to get a calendar."""
    return F.sequence(date_lit(s), date_lit(e), F.expr("interval 1 day"))
