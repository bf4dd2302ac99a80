"""Sleep-app nights from a semicolon-separated export, and CSV files with a declared schema."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulselake.sources.export_xml import subject_column


def _text(c: Column) -> Column:
    return c


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _whole(c: Column) -> Column:
    return F.rint(c.try_cast("double")).try_cast("int")


def _time(c: Column) -> Column:
    return c.try_cast("timestamp_ntz")


def _percent(c: Column) -> Column:
    return F.replace(c, F.lit("%"), F.lit("")).try_cast("double") / 100.0


# Export header, our column, and how to read it. A value that does not fit becomes NULL.
SLEEP_COLUMNS = [
    ("Start", "start_time", _time),
    ("End", "end_time", _time),
    ("Sleep Quality", "sleep_quality", _percent),
    ("Regularity", "regularity", _percent),
    ("Awake (seconds)", "awake_seconds", _number),
    ("Dream (seconds)", "dream_seconds", _number),
    ("Light (seconds)", "light_seconds", _number),
    ("Deep (seconds)", "deep_seconds", _number),
    ("Mood", "mood", _text),
    ("Heart rate (bpm)", "heart_rate_bpm", _number),
    ("Steps", "steps", _whole),
    ("Alarm mode", "alarm_mode", _text),
    ("Air Pressure (Pa)", "air_pressure_pa", _number),
    ("City", "city", _text),
    ("Movements per hour", "movements_per_hour", _number),
    ("Time in bed (seconds)", "time_in_bed_seconds", _number),
    ("Time asleep (seconds)", "time_asleep_seconds", _number),
    ("Time before sleep (seconds)", "time_before_sleep_seconds", _number),
    ("Window start", "window_start", _time),
    ("Window stop", "window_stop", _time),
    ("Snore time (seconds)", "snore_time_seconds", _number),
    ("Weather temperature (°F)", "weather_temperature_f", _number),
    ("Weather type", "weather_type", _text),
    ("Notes", "notes", _text),
    ("Body temperature deviation (degrees Celsius)", "body_temp_deviation_c", _number),
]


#: Columns that the header of a file must name, and the most columns a file may have.
REQUIRED = ("Start", "End")
MOST_COLUMNS = 64


def parse_nights(raw: DataFrame) -> DataFrame:
    """Typed nights from a frame of text columns named as in the export, next to ``subject_id``."""
    return raw.select("subject_id", *[read(F.col(f"`{header}`")).alias(name) for header, name, read in SLEEP_COLUMNS])


def _by_header(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every CSV file under ``path`` as text columns named as in the export, whatever a file's column order.

    Each file is read without a header, so its header is one of its rows: the one that names the columns in REQUIRED.
    It tells where that file has each column. Files without such a row fail the load, columns a file lacks are NULL.
    """
    cells = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(MOST_COLUMNS)])
    lines = (
        spark.read.schema(cells)
        .option("sep", ";")
        .option("header", False)
        .option("multiLine", True)
        .option("escape", '"')
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(path)
    )
    cell = F.array(*(F.regexp_replace(F.col(c), "^\ufeff", "") for c in cells.names))
    rows = lines.select(F.col("_metadata.file_path").alias("file"), "_metadata", cell.alias("cell"))
    names = reduce(and_, (F.array_contains("cell", h) for h in REQUIRED))
    headers = rows.where(names).groupBy("file").agg(F.min("cell").alias("header"))
    body = rows.where(~F.coalesce(names, F.lit(False))).join(headers, "file", "left")
    unknown = F.raise_error(F.concat(F.lit("no header row in "), F.col("file"))).cast("int")
    place = {h: F.when(F.col("header").isNull(), unknown).otherwise(F.array_position("header", h).cast("int")) for h, _, _ in SLEEP_COLUMNS}
    found = [F.when(at > 0, F.get("cell", at - 1)).alias(h) for h, at in place.items()]
    return body.select("_metadata", *found)


def read_nights(spark: SparkSession, path: str, subject_id: int | None = None) -> DataFrame:
    """Nights of every CSV file under ``path``. Notes may span lines, so a (small) file is read by one task."""
    return parse_nights(_by_header(spark, path).withColumn("subject_id", subject_column(subject_id)))


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header and a declared schema; a value that does not fit fails the load."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=False)
