"""The key/value profile: upsert and wide read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.tables import PROFILE_KEYS


def upsert_profile(existing: DataFrame, updates: DataFrame, order_by: str | None = None) -> DataFrame:
    """Existing keys take the updated value, new keys are added, all others stay.

    When ``updates`` itself repeats a key, ``order_by`` (a column of it) says which is last; ties, and updates
    without an order, fall to the larger value. NULL or empty updates change nothing.
    """
    rank = F.col(order_by) if order_by else F.lit(0)
    latest = (
        updates.where(F.length("value") > 0)
        .groupBy("subject_id", "key")
        .agg(F.max_by("value", F.struct(rank.alias("rank"), F.col("value"))).alias("value"))
    )
    kept = existing.select("subject_id", "key", "value").join(
        latest.select("subject_id", "key"), ["subject_id", "key"], "left_anti"
    )
    return kept.unionByName(latest)


def profile_wide(profile: DataFrame) -> DataFrame:
    """One row per subject with a column per known key. Fixed keys: no pass over the data to find them."""
    return profile.groupBy("subject_id").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in PROFILE_KEYS]
    )
