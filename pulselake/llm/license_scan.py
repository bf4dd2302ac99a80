"""License scans: a trained paragraph classifier, confirmed by comparison with templates. DataFrame functions only.

A paragraph (line) is the set of its word bigrams and trigrams. A multinomial logistic regression over the n-grams of
the templates (sparse, binary) gives each family and an unknown class a probability; its temperature is fitted on
variations that the weights have not seen, so that a probability means what it says. A predicted family counts only if
the paragraph also shares enough n-grams with one of that family's templates.

Fitting sees the templates and sentences below and nothing else, on the driver. Scoring explodes the n-grams of every
line and joins them with the weights, a table of as many rows as the templates have n-grams, which is why it may be
broadcast. Rows without a template's n-gram end there, before any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text

UNKNOWN = "unknown"
#: Least probability of a family, and least share of the smaller of paragraph and template, to report it.
REPORT_FROM = 0.5
CONFIRM_FROM = 0.5

# Wording of common license notices by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Distributed under the GPL version 2.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "reserved": (
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ),
}
#: Sentences near in wording that name no license.
OTHERS = (
    "He was released under the condition that he would return, and the public was told of it.",
    "She drives without a license and the general public is at risk.",
    "The terms of the agreement were published by the foundation, either way.",
    "You can use this file and modify it for any purpose.",
    "This program is free of charge for any person.",
    "A copy of the letter was distributed in the hope of help.",
    "The version 2.0 of the engine is faster than version 3.",
    "All copies of the book were sold, with or without the cover.",
    "You should have received a copy of the invoice along with this letter.",
    "This library is open to the public and free on Sundays.",
    "The following conditions are met in most cities of the north.",
    "Use of this road is permitted in any form of weather.",
    "The above copyright office is in the third floor.",
    "Under the terms of the contract the work is done by May.",
    "Apache helicopters flew over the valley, and MIT students watched.",
    "The license plate was found in the field.",
    "The lesser known author of the work waived the fee.",
    "Any later version of the story is either lost or hidden.",
    "The source code of the game was leaked and sold.",
    "The attribution of the painting to the master is in doubt.",
)


def _words(text: str) -> list[str]:
    """As ``_word_array`` does it in Spark."""
    import re

    return [w for w in re.sub(r"[^a-z0-9.+-]+", " ", text.lower()).replace(". ", " ").strip(" .").split(" ") if w]


def _ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)}


@dataclass(frozen=True)
class Model:
    """n-grams with a weight for each class (families, then unknown), class biases, and the templates' n-grams."""

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    templates: tuple[tuple[str, tuple[str, ...]], ...]


@lru_cache(maxsize=1)
def fit(seed: int = 5, variations: int = 24) -> Model:
    """Softmax regression on variations of the templates (words left out, cut, put among others) and of OTHERS."""
    classes = (*TEMPLATES, UNKNOWN)
    vocabulary = sorted(set().union(*(_ngrams(_words(t)) for own in TEMPLATES.values() for t in own)))
    place = {g: k for k, g in enumerate(vocabulary)}
    rng = np.random.default_rng(seed)
    other_words = [w for t in OTHERS for w in _words(t)]

    def features(words: list[str]) -> np.ndarray:
        x = np.zeros(len(vocabulary))
        x[[place[g] for g in _ngrams(words) if g in place]] = 1
        return x

    xs, ys = [], []
    for k, name in enumerate(classes):
        for text in TEMPLATES.get(name, OTHERS):
            words = _words(text)
            for v in range(variations):
                drop = 0.0 if v < variations // 2 else 0.1
                own = [w for w in words if rng.random() >= drop]
                if len(words) > 12 and v % 3 == 1:
                    own = own[: max(8, len(own) * 2 // 3)]
                around = rng.choice(other_words, rng.integers(0, 8)).tolist()
                xs.append(features(around[:3] + own + around[3:]))
                ys.append(k)
                # a stretch of a template too short to tell anything
                if name != UNKNOWN and v % 8 == 0:
                    at = int(rng.integers(0, len(words)))
                    xs.append(features(around + words[at : at + 2]))
                    ys.append(len(classes) - 1)
    x, y = np.stack(xs), np.array(ys)
    fit_rows = np.arange(len(y)) % 4 != 0
    w, b = _softmax_fit(x[fit_rows], y[fit_rows], len(classes))
    logits, truth = x[~fit_rows] @ w + b, y[~fit_rows]
    scales = np.geomspace(0.25, 8, 40)
    losses = [-np.mean(_log_softmax(s * logits)[np.arange(len(truth)), truth]) for s in scales]
    scale = scales[int(np.argmin(losses))]
    w, b = w * scale, b * scale
    templates = tuple((name, tuple(sorted(_ngrams(_words(t))))) for name, own in TEMPLATES.items() for t in own)
    return Model(classes, {g: tuple(map(float, w[k])) for g, k in place.items()}, tuple(map(float, b)), templates)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _softmax_fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 400, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    goal = np.eye(k)[y]
    for _ in range(rounds):
        miss = (np.exp(_log_softmax(x @ w + b)) - goal) / len(y)
        w -= rate * (x.T @ miss + decay * w)
        b -= rate * miss.sum(axis=0)
    return w, b


def _word_array(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), r"[^a-z0-9.+-]+", " "), r"\. ", " ")
    return F.filter(F.split(F.regexp_replace(plain, r"^[ .]+|[ .]+$", ""), " "), lambda w: w != "")


def paragraphs(docs: DataFrame) -> DataFrame:
    """A row for each line of two or more words: doc_id, text_key, paragraph (number from 0), grams (distinct n-grams)."""
    texts = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    lines = texts.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    # exploding one array keeps the optimizer from computing the words anew for each n-gram
    worded = lines.select("doc_id", "text_key", "paragraph", F.explode(F.array(_word_array(F.col("line")))).alias("w")).where(F.size("w") > 1)
    last = F.sequence(F.lit(0), F.size("w") - 2)
    pairs = F.transform(last, lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1)))
    triples = F.transform(last, lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    return worded.select("doc_id", "text_key", "paragraph", F.array_distinct(F.concat(pairs, triples)).alias("grams"))


def _tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    weights = spark.createDataFrame([(g, list(w)) for g, w in model.weights.items()], "gram string, weights array<double>")
    templates = spark.createDataFrame([(name, list(grams)) for name, grams in model.templates], "of string, template_grams array<string>")
    return weights, templates


def license_paragraphs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text_key, paragraph, family, probability, similarity of each paragraph that a template confirms.

    A paragraph gathers the template n-grams it has as a set, at most as many as the templates have, so rows that are
    repeated count once.
    """
    model = model or fit()
    weights, templates = _tables(docs.sparkSession, model)
    found = (
        paragraphs(docs)
        .select("doc_id", "text_key", "paragraph", F.size("grams").alias("n_grams"), F.explode("grams").alias("gram"))
        .join(F.broadcast(weights), "gram")
    )
    paragraph = ["doc_id", "text_key", "paragraph"]
    gathered = found.groupBy(*paragraph, "n_grams").agg(F.collect_set(F.struct("gram", "weights")).alias("seen"))
    start = F.array(*map(F.lit, model.bias))
    logits = F.aggregate("seen", start, lambda z, g: F.zip_with(z, g["weights"], lambda a, b: a + b))
    scored = gathered.select("*", F.explode(F.array(logits)).alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("class", F.array_position("z", F.col("top")).cast("int") - 1).withColumn(
        "probability", 1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    )
    names = F.array(*map(F.lit, model.classes))
    likely = scored.where((F.col("class") < len(model.classes) - 1) & (F.col("probability") >= REPORT_FROM)).withColumn("family", F.get(names, F.col("class")))
    # the templates of the family, each with the n-grams it shares
    shared = F.size(F.array_intersect("seen.gram", "template_grams"))
    similarity = F.max(shared / F.least(F.size("template_grams"), "n_grams")).alias("similarity")
    compared = likely.join(F.broadcast(templates), F.col("of") == F.col("family"))
    return compared.groupBy(*paragraph, "family", "probability").agg(similarity).where(F.col("similarity") >= CONFIRM_FROM)


def license_scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_license_paragraphs, families (sorted, comma-joined), probability, similarity.

    The last two are the greatest of the document's paragraphs and null without one; families is empty then. Null and
    empty texts have no paragraphs; repeated rows have equal results.
    """
    confirmed = license_paragraphs(docs, model).groupBy(F.col("doc_id").alias("id"), "text_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max("probability").alias("probability"),
        F.max("similarity").alias("similarity"),
    )
    rows = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("key"))
    return rows.join(confirmed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("text_key")), "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).alias("n_license_paragraphs"),
        F.coalesce("families", F.lit("")).alias("families"),
        "probability",
        "similarity",
    )
