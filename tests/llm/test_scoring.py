"""Models: language model, quality, toxicity, licences."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pulselake.llm import license_scan, lm_scoring, quality_rules, toxicity
from pulselake.llm.boosted_trees import fit_forest, fit_isotonic

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.mark.parametrize("chunk_tokens", [4_000_000, 500])
def test_lm_scores(docs, rows, chunk_tokens):
    split = [(i, (t or "").encode().translate(LOWER).split() + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    one, two = Counter(), Counter()
    for i, w in split:
        if i is not None and not held(i):
            one.update(w)
            two.update(zip([0, *w], w, strict=False))
    n, v = sum(one.values()), len(one)
    once, twice = (sum(c == k for c in one.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    p = lambda w: (one[w] - d) / n if one[w] else d * v / n
    prior = lm_scoring.PRIOR
    want = Counter()
    for i, w in split:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10((two[h, x] + prior * p(x)) / ((one[None] if h == 0 else one[h]) + prior)) for h, x in zip([0, *w], w, strict=False))
        want[i, held(i), len(w), sum(one[x] > 0 for x in w), n, f"{base:.6f}", f"{score:.6f}"] += 1
    got = lm_scoring.lm_scores(docs, chunk_tokens=chunk_tokens, bucket_documents=20).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6f}", f"{r.score:.6f}") for r in got) == want


def test_model_sums_to_one(docs):
    """Over the known words and the unknown one, after a frequent word."""
    words, pairs = np.array([50, 30, 15, 5, 0]), np.array([10, 0, 5, 0, 0])
    totals = {"tokens": 100, "types": 4, "once": 3, "twice": 2}
    model = lm_scoring.automaton(words, pairs, np.zeros(5, int), np.arange(5), totals, prior=20.0)
    given = 10 ** model.traverse(np.arange(5), np.arange(5), np.zeros(5, int))
    seen = pairs > 0
    p = 10**model.word
    assert np.isclose(p.sum(), 1.0) and np.allclose(given, (pairs + 20 * p) / 70) and np.allclose(given[~seen], 20 / 70 * p[~seen])


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_quality_counts_and_rules(docs, rows, labels):
    want = []
    for i, t in rows:
        w = words_of(t)
        triples = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeats = {k + j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        failed = len(w) < 50 or 100 * len(repeats) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeats), failed))
    got = quality_rules.quality_rules(docs, labels).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:7]) for r in got)
    assert not any(r.kept and r.base_failed for r in got) and any(r.kept for r in got)
    kept = quality_rules.kept_documents(docs, quality_rules.fit(docs, labels))
    assert kept.columns == docs.columns and sorted(map(repr, (r.doc_id for r in got if r.kept))) == sorted(repr(r.doc_id) for r in kept.collect())


def test_monotone_trees_never_turn():
    rng = np.random.default_rng(1)
    x = rng.random((2_000, 3))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + 0.2 * rng.standard_normal(2_000)) > 0.6).astype(float)
    model = fit_forest(x, y, np.array([1, 0, -1]))
    for feature, way in ((0, 1), (2, -1)):
        at = np.repeat(rng.random((20, 3)), 50, axis=0)
        at[:, feature] = np.tile(np.linspace(0, 1, 50), 20)
        assert (way * np.diff(model.margin(at).reshape(20, 50), axis=1) >= -1e-9).all()
    assert ((model.probability(x) > 0.5) == y).mean() > 0.85
    assert fit_forest(np.zeros((0, 3)), np.zeros(0)).probability(x[:2]).tolist() == [0.5, 0.5]


def test_isotonic_rises():
    knots, rates = fit_isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert (np.diff(rates) >= 0).all() and rates[0] < 0.2 < 0.8 < rates[-1] and (np.diff(knots) >= 0).all()


def test_toxicity_of_unseen_texts(spark):
    insults = "gribbel florno zaspit".split()
    data, marks = [], []
    for k in range(600):
        bad = k % 3 == 0
        words = [f"w{(k * 7 + j * 13) % 90}" for j in range(40)]
        if bad:
            words[k % 40] = insults[k % 9 // 3] + ("ish" if k % 2 else "")
        data.append((k, " ".join(words), "toxic", 1))
        marks.append((k, 1, int(bad), "n"))
    docs = spark.createDataFrame([*data, (700, None, "a", 0), (701, "", "b", 0), (None, "x", "c", 0)], "doc_id long, text string, toxic string, half int")
    labels = spark.createDataFrame([*marks, (None, 1, 1, "n")], "doc_id long, quality int, toxic int, half string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out for k in held) and sum(r.held_out for r in got.values()) in (len(held), len(held) + 1, len(held) + 2)
    assert np.mean([got[k].predicted == (k % 3 == 0) for k in held]) > 0.97


def test_toxicity_features_end_with_the_text():
    lexicon = toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    texts = ["idiot one two three four five six seven", "a b", "c", "one two three idiot", "you and one two three four five six moron", "", None, "x y you idiot z", "!!! ???"]
    you = "you " * 30
    alone = [toxicity._features(pa.array([t]), lexicon)[0].tolist() for t in texts]
    together = toxicity._features(pa.array(texts), lexicon).tolist()
    between = toxicity._features(pa.array([you, *(t for own in texts for t in (own, you))]), lexicon)[1::2].tolist()
    assert alone == together == between
    near, spaced = 9, 17
    assert [x[near] for x in alone] == [0, 0, 0, 0, 0, 0, 0, 1, 0] and alone[1][spaced] == alone[2][spaced] == 0


def test_licence_families(spark, docs, rows):
    lines = {
        1: ("intro\nLicensed under CC BY-NC 4.0.\nRELEASED under the MIT license", "cc-by-nc,mit"),
        2: ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        3: ("Released under the moon, he drives without a license", ""),
        4: ("", ""),
        5: (None, ""),
    }
    small = spark.createDataFrame([(i, t, "x") for i, (t, _) in lines.items()] * 2, "doc_id long, text string, family string")
    got = [(r.doc_id, r.families) for r in license_scan.license_scan(small).collect()]
    assert sorted(got) == sorted([(i, f) for i, (_, f) in lines.items()] * 2)
    every = license_scan.license_scan(docs).collect()
    assert len(every) == len(rows) and [r.doc_id for r in every if r.families] == [162]


def test_licences_without_words_of_law_and_wrapped(spark):
    """The model judges every line, also one that has no "license", "copyright" or the like."""
    mit = 'Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software and associated documentation files\n(the "Software"), to deal in the Software without restriction'
    texts = {
        1: ("This work is available under Creative Commons Attribution-ShareAlike 4.0 International.", 1, "cc-by-sa"),
        2: ("CC BY 4.0", 1, "cc-by"),
        3: ("first line\n\nAvailable under CC BY-SA 4.0.", 1, "cc-by-sa"),
        4: (mit, 1, "mit"),  # the model knows its second line, which has no such word
        5: ("The version 2.0 of the engine is faster than version 3.\nAny later version of the story is lost.", 0, ""),
    }
    small = spark.createDataFrame([(i, t) for i, (t, _, _) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_license_paragraphs, r.families) for r in license_scan.license_scan(small).collect()}
    assert got == {i: (n, f) for i, (_, n, f) in texts.items()}


def test_no_documents(nothing, labels):
    assert lm_scoring.lm_scores(nothing).collect() == []
    assert quality_rules.quality_rules(nothing, labels.where("false")).collect() == []
    assert toxicity.toxicity(nothing, labels.where("false")).collect() == []
    assert license_scan.license_scan(nothing).collect() == []
