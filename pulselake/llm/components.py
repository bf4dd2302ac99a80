"""Connected components of an edge table, by alternating large and small star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours tied to the least of them and itself: the larger ones (large step) or the smaller ones."""
    sides = edges.select("u", "v")
    if large:
        sides = sides.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = sides.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # v < u: all of them, and u itself, go to m
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node it reaches) for every node of ``edges`` (u, v); loops and repeats are harmless.

    Edges live in written tables; only a count and a checksum of them reach the driver. The number of rounds grows
    with the logarithm of the longest path.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(now)
    while True:
        now = written(_stars(_stars(now, True), False), "edges")
        then = _mark(now)
        if then == mark:
            break
        mark = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
