"""Health export XML: records, workouts, activity goals and the person, from files of any size.

The stock XML reader parses one file in one task. Here files are read as text split at ``<``, which never occurs
raw inside an attribute value, so each row is one tag and one large export spreads over many tasks. The opening
tag is cut out with its quoted values intact and handed to ``from_xml``. Child elements need no care: everything
wanted is an attribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.numeric import safe_double
from pulselake.tables import SCHEMAS

# Fixed values of the export format.
TYPE_PREFIXES = ["HKQuantityTypeIdentifier", "HKCategoryTypeIdentifier", "HKDataType"]
SEX_NAMES = {
    "HKBiologicalSexMale": "male",
    "HKBiologicalSexFemale": "female",
    "HKBiologicalSexOther": "other",
}
BIRTH_ATTRIBUTE = "HKCharacteristicTypeIdentifierDateOfBirth"
SEX_ATTRIBUTE = "HKCharacteristicTypeIdentifierBiologicalSex"

_ATTRIBUTES = r"""((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*+)\s*/?>"""
_SUBJECT_IN_PATH = r"subject_id=(\d+)"


def subject_column(subject_id: int | None) -> Column:
    """The given subject, or the number after ``subject_id=`` in the file's path; a path without it fails the load."""
    if subject_id is not None:
        return F.lit(subject_id).cast("bigint")
    path = F.col("_metadata.file_path")
    found = F.regexp_extract(path, _SUBJECT_IN_PATH, 1)
    unnamed = F.raise_error(F.concat(F.lit("no subject_id= in the path of "), path)).cast("string")
    return F.when(found != "", found).otherwise(unnamed).cast("bigint")


def read_tags(
    spark: SparkSession, path: str, subject_id: int | None = None, file_name: str = "export.xml"
) -> DataFrame:
    """One row (subject_id, tag) per tag of every export file under ``path``; the tag comes without its ``<``."""
    lines = (
        spark.read.option("lineSep", "<")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .text(path)
    )
    if lines.isEmpty():
        raise FileNotFoundError(f"{file_name} not found under {path}")
    return lines.select(subject_column(subject_id).alias("subject_id"), F.col("value").alias("tag"))


def listed_subjects(
    spark: SparkSession, path: str, subject_id: int | None = None, file_name: str = "export.xml"
) -> DataFrame:
    """The subjects having a file under ``path``, from the file listing alone: no content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file_name)
        .load(path)
    )
    return files.select(subject_column(subject_id).alias("subject_id")).distinct()


def _attributes(tags: DataFrame, element: str, names: list[str]) -> DataFrame:
    """The named attributes of one kind of element as text columns; missing and empty ones are NULL.

    One regular expression both picks the tags (no match, no row) and cuts out the attributes.
    """
    opening = F.lit(rf"^{element}{_ATTRIBUTES}")
    found = tags.where(F.col("tag").startswith(element)).select(
        "subject_id", F.explode(F.regexp_extract_all("tag", opening, F.lit(1))).alias("text")
    )
    schema = ", ".join(f"`_{n}` string" for n in names)
    xml = F.from_xml(F.concat(F.lit("<e"), F.col("text"), F.lit("/>")), schema, {"nullValue": "\u0000"})

    def value(name: str) -> Column:
        text = F.col(f"xml._{name}")
        return F.when(text != "", text).alias(name)

    return found.select("subject_id", xml.alias("xml")).select("subject_id", *[value(n) for n in names])


def short_type(name: Column) -> Column:
    """A type name without its export prefix; other names stay as they are."""
    out = F.when(F.lit(False), name)
    for prefix in TYPE_PREFIXES:
        out = out.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1)))
    return out.otherwise(name)


def wall_clock(text: Column) -> Column:
    """Timestamp as shown on the subject's clock: a UTC offset behind the seconds is dropped, not applied."""
    zoned = F.substring(text, 20, 2).isin(" +", " -")
    return F.when(zoned, F.substring(text, 1, 19)).otherwise(text).try_cast("timestamp_ntz")


def parse_records(tags: DataFrame) -> DataFrame:
    a = _attributes(
        tags,
        "Record",
        ["sourceName", "sourceVersion", "device", "type", "unit", "creationDate", "startDate", "endDate", "value"],
    )
    return a.select(
        "subject_id",
        F.col("sourceName").alias("source_name"),
        F.col("sourceVersion").alias("source_version"),
        "device",
        F.nullif(short_type(F.col("type")), F.lit("")).alias("record_type"),
        "unit",
        wall_clock(F.col("creationDate")).alias("creation_date"),
        wall_clock(F.col("startDate")).alias("start_date"),
        wall_clock(F.col("endDate")).alias("end_date"),
        safe_double(F.col("value")).alias("value"),
    )


def parse_workouts(tags: DataFrame) -> DataFrame:
    a = _attributes(
        tags,
        "Workout",
        [
            "sourceName",
            "sourceVersion",
            "device",
            "creationDate",
            "startDate",
            "endDate",
            "workoutActivityType",
            "duration",
            "durationUnit",
            "totalDistance",
            "totalDistanceUnit",
            "totalEnergyBurned",
            "totalEnergyBurnedUnit",
        ],
    )
    return a.select(
        "subject_id",
        F.col("sourceName").alias("source_name"),
        F.col("sourceVersion").alias("source_version"),
        "device",
        wall_clock(F.col("creationDate")).alias("creation_date"),
        wall_clock(F.col("startDate")).alias("start_date"),
        wall_clock(F.col("endDate")).alias("end_date"),
        F.nullif(short_type(F.col("workoutActivityType")), F.lit("")).alias("workout_activity_type"),
        safe_double(F.col("duration")).alias("duration"),
        F.col("durationUnit").alias("duration_unit"),
        safe_double(F.col("totalDistance")).alias("total_distance"),
        F.col("totalDistanceUnit").alias("total_distance_unit"),
        safe_double(F.col("totalEnergyBurned")).alias("total_energy_burned"),
        F.col("totalEnergyBurnedUnit").alias("total_energy_burned_unit"),
    )


def parse_activity(tags: DataFrame) -> DataFrame:
    numbers = {
        "activeEnergyBurned": "active_energy_burned",
        "activeEnergyBurnedGoal": "active_energy_burned_goal",
        "appleExerciseTime": "apple_exercise_time",
        "appleExerciseTimeGoal": "apple_exercise_time_goal",
        "appleStandHours": "apple_stand_hours",
        "appleStandHoursGoal": "apple_stand_hours_goal",
    }
    a = _attributes(tags, "ActivitySummary", ["dateComponents", "activeEnergyBurnedUnit", *numbers])
    parsed = a.select(
        "subject_id",
        F.col("dateComponents").try_cast("date").alias("date_components"),
        F.col("activeEnergyBurnedUnit").alias("active_energy_burned_unit"),
        *[safe_double(F.col(attr)).alias(name) for attr, name in numbers.items()],
    )
    return parsed.select(*SCHEMAS["activity"].names)


def parse_profile(tags: DataFrame) -> DataFrame:
    """Date of birth and sex as key/value rows; unset or unknown ones give no row."""
    a = _attributes(tags, "Me", [BIRTH_ATTRIBUTE, SEX_ATTRIBUTE])
    sex = F.lit(None).cast("string")
    for name, meaning in SEX_NAMES.items():
        sex = F.when(F.col(SEX_ATTRIBUTE) == name, meaning).otherwise(sex)
    pairs = F.array(
        F.struct(F.lit("date_of_birth").alias("key"), F.col(BIRTH_ATTRIBUTE).alias("value")),
        F.struct(F.lit("sex").alias("key"), sex.alias("value")),
    )
    return (
        a.select("subject_id", F.explode(pairs).alias("p"))
        .select("subject_id", "p.key", "p.value")
        .where(F.col("value").isNotNull())
    )
