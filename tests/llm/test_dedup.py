"""Deduplication against brute force."""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulselake.llm import exact_dedup, near_dedup, substring_dedup
from pulselake.llm.components import components


def found(df, *columns):
    return sorted(df.select(*columns).collect(), key=repr)


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max((i for i in own if i is not None), default=None) for t, own in groups.items()}
    want = [(i, keep[t or ""], len(groups[t or ""]), i == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    got = exact_dedup.exact_duplicates(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_directory_doubles_until_buckets_fit(spark, docs):
    slots = spark.range(3_000).select(F.xxhash64("id").alias("key"))
    buckets = exact_dedup.directory(slots, capacity=100).collect()
    assert sum(b.n_slots for b in buckets) == 3_000 and max(b.n_slots for b in buckets) <= 100
    spans = sorted((b.prefix << (64 - b.depth), (b.prefix + 1) << (64 - b.depth)) for b in buckets)
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(spans))
    one = spark.range(500).select(F.lit(7).cast("long").alias("key"))
    assert [b.n_slots for b in exact_dedup.directory(one, capacity=100).collect()] == [500]
    small = exact_dedup.exact_duplicates(docs, capacity=4)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, exact_dedup.exact_duplicates(docs).collect()))


def test_distinct_documents_keep_columns_and_one_row(docs, rows):
    got = exact_dedup.distinct_documents(docs)
    assert got.columns == docs.columns
    kept = got.select(F.coalesce("text", F.lit(""))).collect()
    assert len(kept) == len({t or "" for _, t in rows}) == len({r[0] for r in kept})


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def linked(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    reach = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    return sets, reach


@pytest.mark.parametrize("block", [4_096, 3])
def test_near_groups(docs, rows, block):
    sets, reach = linked(rows)
    got = near_dedup.near_duplicates(docs, block=block).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), reach[r.doc_id], r.doc_id == reach[r.doc_id]), r.doc_id


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**63, 4_000).astype(np.uint64) for _ in range(2))
    both = np.unique(np.concatenate([a, b]))
    assert (near_dedup.merged(near_dedup.sketch(a), near_dedup.sketch(b)) == near_dedup.sketch(both)).all()
    near = np.unique(np.concatenate([a[:3_600], b[:400]]))  # similarity 0.82
    far = np.unique(np.concatenate([a[:2_400], b[:1_600]]))  # similarity 0.43
    one = near_dedup.sketch(np.unique(a))
    told = near_dedup.may_link(one, len(a), np.stack([near_dedup.sketch(near), near_dedup.sketch(far)]), np.array([len(near), len(far)]))
    assert told.tolist() == [True, False]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(30)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 500: 500, 501: 500}


def test_repeated_windows(docs, rows):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(i, first.get(key, i))
    want = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        rest = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(rest).hexdigest()))
    got = substring_dedup.remove_repeats(docs, shard_documents=16)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())
    assert sum(w[2] for w in want) > 200


def test_two_texts_under_one_id(spark):
    """Each row has a result; a copy loses its words to the smaller doc_id, whatever else has its own."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    docs = spark.createDataFrame([(3, b), (5, b), (5, a), (9, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect())
    whole, none = (lambda t: hashlib.sha256(t.encode()).hexdigest()), hashlib.sha256(b"").hexdigest()
    assert got == sorted([(3, 60, 0, whole(b)), (5, 60, 60, none), (5, 60, 0, whole(a)), (9, 60, 60, none)])


def test_no_documents(nothing):
    assert exact_dedup.exact_duplicates(nothing).collect() == []
    assert near_dedup.near_duplicates(nothing).collect() == []
    assert substring_dedup.remove_repeats(nothing).collect() == []
