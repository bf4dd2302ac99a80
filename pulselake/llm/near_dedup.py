"""Near-duplicate detection with SetSketch registers: band, estimate jointly by likelihood, verify.

A document is the set of its word shingles. Its sketch holds, for each of REGISTERS hash functions, the least
exponential variate of the set on a logarithmic scale, truncated to 16 bits: ``1 - log_b(min)``, rounded down. Sketches
merge by the larger register, and two sets agree in a register about as often as their Jaccard similarity.

1. Texts with equal shingle sets form a class; its smallest doc_id stands for it from here on.
2. BANDS bands of ROWS registers; documents that share a band are a bucket. Within a bucket, the joint likelihood of the
   registers given both set sizes tells which pairs may be similar enough. This yields clusters.
3. Only documents in clusters get their shingle sets again, and a cluster's pairs are confirmed on full sets.

Both steps compare inside tasks and leave a spanning forest, not pairs (``link``). Documents already connected are not
compared again, so a group of copies costs about its size. A group of any size is dealt to blocks of bounded size; all
its blocks meet one common member, and what is still apart then is compared block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .components import components
from .text_arrays import blocks, mix

SHINGLE_WORDS = 5
#: Similarity from which documents are linked, in hundredths.
LINK_FROM = 75
#: At similarity 0.75 a pair shares none of the bands with a probability of 0.25 in a million.
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
#: Pairs whose likeliest similarity is less are not verified: over four standard errors below LINK_FROM.
ESTIMATE_FROM = 0.60
#: SetSketch: base and rate of the register scale.
BASE, RATE = 1.001, 20.0
#: Documents of a group that one task compares.
BLOCK = 4_096
#: Groups up to this size are compared many at a time.
SMALL_GROUP = 16

_MULTIPLIERS = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit shingle hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for lo in range(0, len(high), 2048):
        np.minimum(low, (high[lo : lo + 2048] * _MULTIPLIERS).min(axis=0), out=low)
    least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def may_link(one: np.ndarray, size: int | np.ndarray, others: np.ndarray, sizes: np.ndarray, at: float = ESTIMATE_FROM) -> np.ndarray:
    """Whether the likeliest similarity of ``one`` (or of each row of it) to each of ``others`` is at least ``at``.

    Registers of two sets with shares u and v of their sizes' sum are greater, less or equal with probabilities
    p(u - vJ), p(v - uJ) and the rest, where p(x) = -log_b(1 - x (b - 1) / b). The log-likelihood has one peak in J, so
    its slope at ``at`` tells on which side the peak lies. Pairs whose sizes rule LINK_FROM out fail at once.
    """
    small, large = np.minimum(size, sizes), np.maximum(size, sizes)
    found = np.zeros(len(sizes), bool)
    where = np.flatnonzero(100 * small >= LINK_FROM * large)
    if not len(where):
        return found
    theirs, n = others[where], sizes[where].astype(float)
    if one.ndim == 2:
        one, size = one[where], size[where]
    greater, less = (one > theirs).sum(axis=1), (one < theirs).sum(axis=1)
    u, v = size / (size + n), n / (size + n)
    c = (BASE - 1) / BASE
    p, q = (-np.log(1 - np.maximum(x, 1e-12) * c) / np.log(BASE) for x in (u - v * at, v - u * at))
    dp, dq = (-y * c / (1 - np.maximum(x, 1e-12) * c) / np.log(BASE) for x, y in ((u - v * at, v), (v - u * at, u)))
    slope = greater * dp / np.maximum(p, 1e-12) + less * dq / np.maximum(q, 1e-12) - (REGISTERS - greater - less) * (dp + dq) / np.maximum(1 - p - q, 1e-12)
    found[where] = slope >= 0
    return found


def _shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for b in blocks(texts):
        words = b.word_hash(lower=True)
        at = b.windows(SHINGLE_WORDS)
        runs = b.run_hash(words, at, at + SHINGLE_WORDS)
        cut = np.searchsorted(b.doc[at], np.arange(b.hi - b.lo + 1))
        counts = np.diff(b.first)
        for k in range(b.hi - b.lo):
            if 0 < counts[k] < SHINGLE_WORDS:
                yield b.run_hash(words, b.first[k : k + 1], b.first[k + 1 : k + 2])
            else:
                yield np.unique(runs[cut[k] : cut[k + 1]])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two 64-bit sums that name the set, and the registers (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_shingle_sets(batch.column("text")))
            sums = np.array([[mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] for s in sets], np.uint64)
            sums = sums.reshape(-1, 2).view(np.int64)
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_a": np.ascontiguousarray(sums[:, 0]),
                    "set_b": np.ascontiguousarray(sums[:, 1]),
                    "registers": pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, registers binary")


def _band_keys(standing: DataFrame) -> DataFrame:
    """(bucket, doc_id) for each band of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
            packed = np.ascontiguousarray(k).view(np.uint64).reshape(-1, BANDS)
            keys = mix(packed ^ mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1)))
            yield pa.record_batch({"bucket": keys.ravel().view(np.int64), "doc_id": np.repeat(np.asarray(batch.column("doc_id")), BANDS)})

    return standing.select("doc_id", "registers").mapInArrow(run, "bucket long, doc_id long")


def _forest(doc: np.ndarray, k: np.ndarray, size: np.ndarray, sets: list[np.ndarray] | None, label: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what is similar among the members: each of ``rows`` against later or other ``columns``.

    ``label`` (changed in place) says what is joined already. Without ``sets`` an edge is a likely link, with them a
    confirmed one, the likeliest partners being tried first.
    """
    edges = []
    for x in rows.tolist():
        other = columns[(columns > x) if rows is columns else (columns != x)]
        other = other[label[other] != label[x]]
        if not len(other):
            continue
        near = other[may_link(k[x], size[x], k[other], size[other])]
        if sets is not None and len(near) > 1:
            near = near[np.argsort(-(k[x] == k[near]).sum(axis=1), kind="stable")]
        for y in near.tolist():
            if label[y] == label[x]:
                continue
            if sets is not None and not _linked(sets[x], sets[y]):
                continue
            edges.append((int(doc[x]), int(doc[y])))
            label[label == label[y]] = label[x]
    return edges


def _segment_pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each of many small segments, segment after segment, some at a time."""
    for m in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(m, 1)
        own, step = start[size == m], max(1, 50_000 // len(i))
        for lo in range(0, len(own), step):
            yield (own[lo : lo + step, None] + i).ravel(), (own[lo : lo + step, None] + j).ravel()


def _linker(exact: bool):
    """Edges of the groups of a batch: small groups together, each larger one on its own."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        group = ["group_id", "part", "strip"]
        batch = batch.drop_duplicates([*group, "doc_id", "role"]).sort_values([*group, "doc_id", "role"]).reset_index(drop=True)
        k = np.frombuffer(b"".join(batch["registers"]), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(s, np.uint64) for s in batch["shingles"]] if exact else None
        doc, n, role = (batch[c].to_numpy() for c in ("doc_id", "n_shingles", "role"))
        label = np.unique(batch["label"].to_numpy(), return_inverse=True)[1]
        keys = batch[group].to_numpy()
        start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))) if len(batch) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(batch)))
        small = (size <= SMALL_GROUP) & (np.add.reduceat(role, start) == 0) if len(start) else np.zeros(0, bool)
        whose = np.repeat(start, size)
        end = dict(zip(start.tolist(), (start + size).tolist(), strict=True))
        edges: list[tuple[int, int]] = []
        for a, b in _segment_pairs(start[small], size[small]):
            near = may_link(k[a], n[a], k[b], n[b])
            for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
                if label[x] == label[y] or (sets is not None and not _linked(sets[x], sets[y])):
                    continue
                edges.append((int(doc[x]), int(doc[y])))
                own = slice(int(whose[x]), end[int(whose[x])])
                label[own][label[own] == label[y]] = label[x]
        for lo in start[~small].tolist():
            own = slice(lo, end[lo])
            everyone = np.arange(end[lo] - lo)
            ones = role[own]
            rows, columns = (everyone, everyone) if not ones.any() else (everyone[ones == 1], everyone[ones == 2])
            edges += _forest(doc[own], k[own], n[own], sets and sets[own], label[own].copy(), rows, columns)
        return pd.DataFrame(edges, columns=["u", "v"], dtype="int64")

    return run


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LINK_FROM * (len(a) + len(b) - both)


def _edges(dealt: DataFrame, exact: bool, block: int) -> DataFrame:
    """``dealt``: members with part, strip, role and label. Groups are worked on some at a time, about a block of rows."""
    batches = max(1, math.ceil(dealt.count() / block))
    batch = F.pmod(F.xxhash64("group_id", "part", "strip"), F.lit(batches)).alias("batch")
    return dealt.select("*", batch).groupBy("batch").applyInPandas(_linker(exact), "u long, v long")


def link(members: DataFrame, exact: bool, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect, within each group, what is similar; a forest of each block.

    ``members``: group_id, doc_id, n_shingles, registers and, if ``exact``, shingles. Groups over ``block`` documents are
    dealt to blocks, to each of which the group's first document by hash is added. Documents that then are outside
    their group's largest component are compared with the whole group, block against block.
    """
    held = ["group_id", "doc_id", "n_shingles", "registers"] + ["shingles"] * exact
    sizes = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("doc_id").alias("by"), "doc_id"))["doc_id"].alias("head")
    )
    sizes = written(sizes.where("size > 1"), "groups").withColumn("parts", F.ceil(F.col("size") / block).cast("long"))
    rows = members.select(*held).join(sizes, "group_id")
    own = F.array(F.pmod(F.xxhash64("doc_id", "group_id"), "parts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    dealt = rows.withColumn("part", F.explode(F.when(F.col("doc_id") == F.col("head"), every).otherwise(own)))
    zero = F.lit(0).cast("long")
    dealt = dealt.select(*held, "part", zero.alias("strip"), F.lit(0).alias("role"), F.col("doc_id").alias("label"))
    edges = written(_edges(dealt, exact, block).distinct(), "links")
    large = sizes.where("parts > 1")
    if large.isEmpty():
        return edges
    found = written(components(edges).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "label"), "labels")
    big = members.select(*held).join(large.select("group_id", "parts"), "group_id").join(found, "doc_id", "left")
    big = written(big.withColumn("label", F.coalesce("label", "doc_id")), "large")
    counts = big.groupBy("group_id", "label").count()
    most = counts.groupBy("group_id").agg(F.max(F.struct("count", "label"))["label"].alias("main"))
    big = big.join(most, "group_id").withColumn("part", F.pmod(F.xxhash64("doc_id", "group_id"), "parts"))
    apart = big.where("label <> main")
    strips = apart.groupBy("group_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("strips"))
    strip = F.pmod(F.xxhash64("group_id", "doc_id", F.lit("strip")), "strips")
    ones = apart.join(strips, "group_id").withColumn("strip", strip).withColumn("part", F.explode(every)).withColumn("role", F.lit(1))
    all_ = big.join(strips, "group_id").withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.col("strips") - 1))).withColumn("role", F.lit(2))
    grid = ones.select(*held, "part", "strip", "role", "label").unionByName(all_.select(*held, "part", "strip", "role", "label"))
    return written(edges.unionByName(_edges(grid, exact, block)).distinct(), "links")


def _with_sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (with a column doc_id) with the shingle sets of these documents, made anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in _shingle_sets(batch.column("text"))], pa.binary())
            yield pa.record_batch([*(c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"), sets], [*(n for n in batch.schema.names if n != "text"), "shingles"])

    rows = id_and_text(docs).join(chosen, "doc_id")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{fields}, shingles binary")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing; so are rows with a
    null doc_id, which stay (component_id null, kept). Rows repeated with one doc_id share a component.
    """
    sketched = written(sketches(docs), "sketches")
    some = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("standing"))
    classes = written(classes, "classes")
    standing = (
        some.join(classes, ["set_a", "set_b", "n_shingles"])
        .where("doc_id = standing")
        .select("doc_id", "n_shingles", "registers")
        .dropDuplicates(["doc_id"])
    )
    standing = written(standing, "standing")

    keys = _band_keys(standing)
    shared = keys.groupBy("bucket").count().where("count > 1").select("bucket")
    buckets = written(keys.join(shared, "bucket").withColumnRenamed("bucket", "group_id"), "buckets")
    likely = link(buckets.join(standing, "doc_id"), exact=False, block=block)
    clusters = components(likely).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))
    clustered = written(clusters.join(standing, "doc_id"), "clusters")
    links = link(written(_with_sets(docs, clustered).dropDuplicates(["group_id", "doc_id"]), "sets"), exact=True, block=block)
    joined = components(links)

    of_class = classes.join(joined, classes["standing"] == joined["node"], "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "standing").alias("component")
    )
    return sketched.join(of_class, ["set_a", "set_b", "n_shingles"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id")).cast("long").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.v FROM reached r JOIN links l ON r.other = l.u
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""
