"""Exact deduplication over an extendible-hash index kept in shared files. DataFrame functions only.

Every text has a 64-bit key. Equal texts are folded by (key, text) first: a grouping that compares the bytes, so two
texts with one key stay apart, and that folds the copies of a task before anything is shuffled; however many copies a
text has, one row a task leaves. What remains, a slot for each distinct text, is dealt to buckets by the leading bits
of the key. A bucket with more than ``capacity`` slots is split by one more bit (the directory doubles) until it fits
or holds a single key. Owner tasks get ranges of keys, number the slots of a key into a chain and write them; rows then
look their slot up by key and digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, written

#: Slots in a bucket before it is split.
CAPACITY = 1 << 16


def _leading(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def slots(docs: DataFrame) -> DataFrame:
    """One row per distinct text: key, digest, keep_id (largest doc_id), group_size."""
    texts = id_and_text(docs).withColumn("key", F.xxhash64("text"))
    return (
        texts.groupBy("key", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", F.sha2("text", 256).alias("digest"), "keep_id", "group_size")
    )


def directory(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Buckets of ``found`` (with a column key): depth, prefix, n_slots. Every key falls into exactly one.

    Starts at the depth at which buckets are half full on average; each round looks only at the keys of buckets that
    are too full, so it ends after a few rounds, at the latest when a bucket has one key (or 64 bits are used up).
    """
    depth = max(0, math.ceil(math.log2(max(1, found.count()) * 2 / capacity)))
    open_keys, done = found.select("key"), None
    while True:
        cells = (
            open_keys.groupBy(_leading(depth).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("n_slots"), F.min("key").alias("low"), F.max("key").alias("high"))
            .withColumn("full", (F.col("n_slots") > capacity) & (F.col("low") != F.col("high")) & F.lit(depth < 64))
        )
        cells = written(cells.select(F.lit(depth).alias("depth"), "prefix", "n_slots", "full"), "directory")
        fitting = cells.where(~F.col("full")).select("depth", "prefix", "n_slots")
        done = fitting if done is None else done.unionByName(fitting)
        full = cells.where("full").select("prefix")
        if full.isEmpty():
            return done
        open_keys = open_keys.join(full, _leading(depth) == full["prefix"], "left_semi")
        depth += 1


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The directory and the index: slots with their bucket's depth and prefix and their place in the key's chain."""
    found = written(slots(docs), "slots")
    buckets = written(directory(found, capacity), "directory")
    depths = [r.depth for r in buckets.select("depth").distinct().collect()]  # at most 65 small numbers
    placed = None
    for depth in depths:
        level = buckets.where(F.col("depth") == depth).select("depth", "prefix")
        part = found.join(level, _leading(depth) == level["prefix"])
        placed = part if placed is None else placed.unionByName(part)
    if placed is None:
        placed = found.select("*", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"))
    owned = placed.repartitionByRange("key")
    chain = F.row_number().over(Window.partitionBy("key").orderBy("digest"))
    return buckets, written(owned.withColumn("chain", chain), "index")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text equals the empty one. The largest doc_id of a group stays; a
    null doc_id never does unless the group has no other. Repeated rows with that doc_id are all marked kept (an
    operator over ids cannot tell them apart), and ``distinct_documents`` leaves one of them. No rows give no rows.
    """
    _, index = build_index(docs, capacity)
    rows = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("digest"))
    return rows.join(index.select("key", "digest", "keep_id", "group_size"), ["key", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; of repeated rows one."""
    _, index = build_index(docs, capacity)
    keep = index.select("key", "digest", "keep_id")
    text = F.coalesce(docs["text"], F.lit(""))
    stay = docs.join(
        keep,
        (F.xxhash64(text) == keep["key"]) & (F.sha2(text, 256) == keep["digest"]) & docs["doc_id"].eqNullSafe(keep["keep_id"]),
        "left_semi",
    )
    repeated = docs.groupBy("doc_id").count().where("count > 1")  # reads the ids alone
    return stay if repeated.isEmpty() else stay.dropDuplicates(["doc_id", "text"])


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
