"""Session settings the operators are tuned for. All are ordinary Spark options; any session works."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE sizes and splits shuffle partitions at run time; the initial number is set high on a cluster.
OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "pulselake", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**OPTIONS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
