"""Row-ordered calculations over *raw* rows without putting one key into one task.

``Window.partitionBy(subject)`` is fine over per-day aggregates (a subject has few days), but over raw rows a
single subject or track can hold a large share of the table. Here every window is keyed by a time slice too:

1. number rows (or add up weights) inside (key, slice), and total the slices with a normal aggregation;
2. a running total over slice counts (one row per slice) gives each slice its offset, so ``pos`` is the row's
   place in the whole key;
3. frames reaching ``n`` rows back work on blocks of ``block`` consecutive positions: each block also receives
   the last ``n`` rows of the block before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
_LAST_SLICE = 2**62


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: Column,
    order: Sequence[Column],
    weight: Column | None = None,
) -> DataFrame:
    """Add ``pos`` (running total of ``weight`` within ``keys``, by slice then ``order``) and ``total``.

    Without a weight every row counts 1, so ``pos`` is the row's place. ``slice_col`` is a whole number that grows
    with ``order``; NULL slices come last. ``keys`` are never NULL.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", F.coalesce(slice_col.cast("bigint"), F.lit(_LAST_SLICE))).withColumn(
        "_weight", (F.lit(1) if weight is None else weight).cast("bigint")
    )
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = sliced.withColumn("_upto", F.sum("_weight").over(in_slice))

    # One row per (key, slice), so the running total over a key is bounded by the number of slices.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_weight").alias("_in_slice"))
        .select(
            *keys,
            "_slice",
            F.coalesce(F.sum("_in_slice").over(before), F.lit(0)).alias("_offset"),
            F.sum("_in_slice").over(Window.partitionBy(*keys)).alias("total"),
        )
    )
    # The window above already placed rows by (key, slice); the join reuses that placement.
    return (
        summed.join(offsets, [*keys, "_slice"], "inner")
        .withColumn("pos", F.col("_offset") + F.col("_upto"))
        .drop("_slice", "_weight", "_upto", "_offset")
    )


def in_blocks(df: DataFrame, back: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Give each row a ``_block``; the last ``back`` rows of a block are repeated in the next as ``_carried``.

    ``block`` is raised to ``back`` when smaller, so one neighbour is always enough.
    """
    block = max(block, back, 1)
    home = F.floor((F.col("pos") - 1) / F.lit(block)).cast("bigint")
    tail = (F.col("pos") - 1) % block >= block - back
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    return (
        df.withColumn("_home", home)
        .withColumn("_block", F.explode(copies))
        .withColumn("_carried", F.col("_block") != F.col("_home"))
        .drop("_home")
    )


def trailing_over_rows(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: Column,
    order: Sequence[Column],
    rows: int,
    aggregates: dict[str, Column],
) -> DataFrame:
    """Add each aggregate over the current row and the ``rows - 1`` rows before it, per key."""
    placed = in_blocks(with_running_total(df, keys, slice_col, order), rows - 1)
    frame = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(-(rows - 1), 0)
    out = placed.select("*", *[agg.over(frame).alias(name) for name, agg in aggregates.items()])
    return out.where(~F.col("_carried")).drop("_block", "_carried", "total")
