"""The period digest: a sectioned text per subject, built as one column expression over ``period_stats``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.numeric import half_even
from pulselake.operators.routes import TYPE_PREFIX


def _whole(x: Column) -> Column:
    """A double without decimals."""
    return F.format_string("%d", F.rint(x).cast("bigint"))


def _count(x: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(x, 0)


def _has(x: Column) -> Column:
    """Present and not zero: other metrics are left out of the text."""
    return x.isNotNull() & (x != 0)


def _line(condition: Column | None, *parts: Column | str) -> Column:
    text = F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) if isinstance(p, Column) else F.lit(p) for p in parts])
    return text if condition is None else F.when(condition, text)


def digest_text() -> Column:
    """Lines joined by newlines; a line whose condition fails is NULL and thereby skipped.

    The wording is fixed: readers of the digest rely on it.
    """

    def c(path: str) -> Column:
        return F.col(path)

    known = [c(f"profile.{k}") for k in ("age", "sex", "weight_lbs", "height_in", "date_of_birth")]
    any_profile = F.coalesce(*known).isNotNull()

    def given(key: str) -> Column:
        return F.length(c(f"profile.{key}")) > 0

    by_type = F.when(
        F.size("by_type") > 0,
        F.array_join(
            F.transform(
                "by_type",
                lambda w: F.concat(
                    F.lit("  - "),
                    F.replace(F.coalesce(w["type"], F.lit("")), F.lit(TYPE_PREFIX), F.lit("")),
                    F.lit(": "),
                    w["count"].cast("string"),
                    F.lit("x ("),
                    _whole(w["total_min"]),
                    F.lit(" min)"),
                ),
            ),
            "\n",
        ),
    )
    tracked = c("activity_rings.days_tracked") > 0
    lines = [
        _line(None, "# Health data for ", c("period.start"), " to ", c("period.end")),
        _line(None, "Period length: ", c("period.days"), " days\n"),
        _line(any_profile, "## User Profile"),
        _line(given("age"), "- Age: ", c("profile.age"), " years"),
        _line(given("sex"), "- Sex: ", c("profile.sex")),
        _line(given("weight_lbs"), "- Weight: ", c("profile.weight_lbs"), " lbs"),
        _line(given("height_in"), "- Height: ", c("profile.height_in"), " inches"),
        _line(any_profile, ""),
        _line(None, "## Steps"),
        _line(None, "- Daily average: ", _count(c("steps.daily_avg"))),
        _line(None, "- Total: ", _count(c("steps.total"))),
        _line(None, "- Best day: ", _count(c("steps.max_day")), " steps"),
        _line(None, "- Lowest day: ", _count(c("steps.min_day")), " steps"),
        _line(
            _has(c("steps.prior_daily_avg")), "- Prior period daily average: ", _count(c("steps.prior_daily_avg"))
        ),
        _line(None, "\n## Heart Rate"),
        _line(_has(c("heart_rate.avg_resting")), "- Average resting HR: ", c("heart_rate.avg_resting"), " bpm"),
        _line(
            _has(c("heart_rate.avg_resting")),
            "- Resting HR range: ",
            c("heart_rate.min_resting"),
            " - ",
            c("heart_rate.max_resting"),
            " bpm",
        ),
        _line(
            _has(c("heart_rate.avg_overall")),
            "- Overall HR range: ",
            c("heart_rate.min_overall"),
            " - ",
            c("heart_rate.max_overall"),
            " bpm",
        ),
        _line(
            _has(c("heart_rate.prior_avg_resting")),
            "- Prior period avg resting HR: ",
            c("heart_rate.prior_avg_resting"),
            " bpm",
        ),
        _line(None, "\n## Sleep"),
        _line(_has(c("sleep.avg_hours")), "- Average sleep: ", c("sleep.avg_hours"), " hours/night"),
        _line(
            _has(c("sleep.avg_hours")), "- Range: ", c("sleep.min_hours"), " - ", c("sleep.max_hours"), " hours"
        ),
        _line(_has(c("sleep.avg_hours")), "- Nights tracked: ", c("sleep.nights_tracked")),
        _line(
            _has(c("sleep.avg_quality_pct")),
            "- Average sleep quality (SleepCycle): ",
            c("sleep.avg_quality_pct"),
            "%",
        ),
        _line(
            _has(c("sleep.avg_deep_min")),
            "- Sleep stages avg: ",
            _whole(c("sleep.avg_deep_min")),
            "min deep, ",
            _whole(c("sleep.avg_light_min")),
            "min light, ",
            _whole(c("sleep.avg_dream_min")),
            "min dream, ",
            _whole(c("sleep.avg_awake_min")),
            "min awake",
        ),
        _line(_has(c("sleep.prior_avg_hours")), "- Prior period avg: ", c("sleep.prior_avg_hours"), " hours/night"),
        _line(None, "\n## Workouts"),
        _line(None, "- Total workouts: ", c("workouts.count")),
        _line(
            _has(c("workouts.total_duration_min")),
            "- Total duration: ",
            _whole(c("workouts.total_duration_min")),
            " minutes",
        ),
        _line(
            _has(c("workouts.total_distance")),
            "- Total distance: ",
            F.format_string("%.1f", half_even(c("workouts.total_distance"), 1)),
        ),
        _line(
            _has(c("workouts.avg_calories")),
            "- Average calories burned: ",
            _whole(c("workouts.avg_calories")),
            " kcal",
        ),
        _line(by_type.isNotNull(), "- Breakdown by type:"),
        by_type,
        _line(None, "\n## Activity Rings"),
        _line(None, "- Days tracked: ", c("activity_rings.days_tracked")),
        _line(tracked, "- Move ring closed: ", c("activity_rings.move_close_pct"), "% of days"),
        _line(tracked, "- Exercise ring closed: ", c("activity_rings.exercise_close_pct"), "% of days"),
        _line(tracked, "- Stand ring closed: ", c("activity_rings.stand_close_pct"), "% of days"),
        _line(tracked, "- All three rings closed: ", c("activity_rings.all_rings_closed_days"), " days"),
    ]
    return F.concat_ws("\n", *lines)


def period_digest(stats: DataFrame) -> DataFrame:
    return stats.select("subject_id", digest_text().alias("digest"))


def question_digest(stats: DataFrame, question: str) -> DataFrame:
    """The digest under a question, each in its own section."""
    text = F.concat(F.lit("## My question\n\n"), F.lit(question), F.lit("\n\n---\n\n## My health data\n\n"), digest_text())
    return stats.select("subject_id", text.alias("digest"))
