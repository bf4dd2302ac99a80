"""Toxicity: boosted trees over dense features, their scores calibrated by isotonic regression.

Features of a text: densities of a lexicon of insulting words, the share of hits near a second-person word, rates of
capitals, punctuation and obfuscated spellings. The lexicon is learned: word forms and word beginnings that labelled
toxic training texts have far more often than the others, found by a distributed count and bounded in number; a short
list of English insults seeds it. While the trees are fitted, a text is measured with the lexicon of the other half of
the sample, so that they learn what a hit in an unseen text is worth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted_trees import Forest, fit_forest, fit_isotonic
from .common import fold, id_and_text
from .text_arrays import BLANK, Block, _block, blocks

#: Labelled rows the model is fitted on, at most, and word forms in its lexicon.
TRAINING_ROWS = 20_000
LEXICON_SIZE = 8_192
#: A form enters the lexicon when so many toxic texts have it, and at so many times the rate of the others.
LEAST_TEXTS = 4
LEAST_RATIO = 6.0
#: Bytes of the beginnings that are counted besides whole words.
BEGINNINGS = (4, 5, 6)
TOXIC_FROM = 0.3

# Common English insults and second-person words of the four languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb fool loser losers scum trash garbage pathetic disgusting worthless clown "
    "imbecile bastard bitch asshole jerk freak creep vermin coward liar filth pig retard dimwit crap fuck fucking shit"
).split()
YOU = "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted tus vosotros".split()
#: Characters written for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = 18


def _letters() -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[65:91] = mask[97:123] = mask[128:] = True
    return mask


_LETTER = _letters()
_ASCII_UPPER = np.zeros(256, bool)
_ASCII_UPPER[65:91] = True
_FOLDED = np.arange(256, dtype=np.uint8)
for _from, _to in LOOKALIKES.items():
    _FOLDED[ord(_from)] = ord(_to)
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _hashes(words: list[str]) -> np.ndarray:
    b = next(blocks(pa.array([" ".join(words)])))
    return np.sort(b.word_hash(True))


_INSULT_HASHES, _YOU_HASHES = _hashes(INSULTS), _hashes(YOU)


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of word forms and the log of how much likelier each is in a toxic text."""

    form: np.ndarray
    weight: np.ndarray

    def weigh(self, form: np.ndarray) -> np.ndarray:
        if not len(self.form):
            return np.zeros(len(form))
        at = np.minimum(np.searchsorted(self.form, form), len(self.form) - 1)
        return np.where(self.form[at] == form, self.weight[at], 0.0)


def _runs(data: np.ndarray, at: np.ndarray, solid: np.ndarray) -> Block:
    """A block whose words are the runs of ``solid`` bytes."""
    return _block(0, len(at) - 1, np.where(solid, data, np.uint8(32)), at)


def _forms(b: Block) -> list[np.ndarray]:
    """Hashes of the runs of letters, whole and their beginnings, ASCII letters in lower case."""
    size = b.end - b.start
    return [b.span_hash(b.start, b.end, True)] + [b.span_hash(b.start, b.start + np.minimum(size, k), True) ^ np.uint64(k) for k in BEGINNINGS]


def block_forms(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, form) of a block."""
    runs = _runs(b.data, b.at, _LETTER[b.data])
    forms = np.concatenate(_forms(runs))
    doc = np.tile(runs.doc, 1 + len(BEGINNINGS))
    order = np.lexsort((forms, doc))
    doc, forms = doc[order], forms[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (forms[1:] != forms[:-1])
    return doc[new], forms[new]


def block_features(b: Block, lexicon: Lexicon) -> np.ndarray:
    n, data = b.hi - b.lo, b.data
    total = lambda doc, what=None: np.bincount(doc, what, n)[:n]
    plain = _runs(data, b.at, _LETTER[data])
    words = np.maximum(np.diff(plain.first), 1)
    forms = _forms(plain)
    weights = np.stack([lexicon.weigh(f) for f in forms])
    seed = np.isin(forms[0], _INSULT_HASHES)
    weight = np.maximum(weights.max(axis=0), 3.0 * seed)
    hit = weight > 0
    best = np.zeros(n)
    np.maximum.at(best, plain.doc, weight)

    # hits with a second-person word among the five words of the same text on either side
    you = np.isin(forms[0], _YOU_HASHES)
    so_far = np.zeros(len(you) + 1, np.int64)
    np.cumsum(you, out=so_far[1:])
    place = np.arange(len(you))
    near = so_far[np.minimum(place + 6, plain.first[plain.doc + 1])] > so_far[np.maximum(place - 5, plain.first[plain.doc])]
    caps = total(plain.doc, _upper_words(plain))

    # spellings with digits or signs for letters: hits that show only after folding, mixed words, spaced letters
    lookalike = _LETTER | _DIGIT
    lookalike[[ord("@"), ord("$"), ord("!")]] = True
    folded = _runs(_FOLDED[data], b.at, lookalike[data])
    hidden_weight = np.maximum.reduce([lexicon.weigh(f) for f in _forms(folded)] + [3.0 * np.isin(folded.span_hash(folded.start, folded.end, True), _INSULT_HASHES)])
    changed = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_FOLDED[data] != data, out=changed[1:])
    mixed = changed[folded.end] > changed[folded.start]
    single = (plain.end - plain.start) == 1
    one_text = plain.doc[:-2] == plain.doc[2:]
    spaced = single[1:-1] & single[:-2] & single[2:] & one_text if len(single) > 2 else np.zeros(0, bool)
    chars = np.maximum(np.diff(b.at), 1)
    return np.stack(
        [
            total(plain.doc, hit) / words,
            np.log1p(total(plain.doc, hit)),
            total(plain.doc, weight) / words,
            np.log1p(total(plain.doc, weight)),
            best,
            total(plain.doc, weight >= 3) / words,
            np.log1p(total(plain.doc, weight >= 3)),
            np.log1p(total(plain.doc, weights[0] > 0)),
            np.log1p(total(plain.doc, seed)),
            total(plain.doc, hit & near) / np.maximum(total(plain.doc, hit), 1),
            total(plain.doc, you) / words,
            caps / words,
            b.counts(_ASCII_UPPER[data]) / chars,
            b.counts(_PUNCT[data]) / chars,
            b.counts(data == 33) / chars,
            np.log1p(total(folded.doc, mixed * (hidden_weight > 0))),
            total(folded.doc, mixed) / words,
            (total(plain.doc[1:-1], spaced) if len(spaced) else np.zeros(n)) / words,
        ],
        axis=1,
    )


def _upper_words(b: Block) -> np.ndarray:
    """Whether each run has two or more letters, all ASCII capitals."""
    sums = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(_ASCII_UPPER[b.data], out=sums[1:])
    size = b.end - b.start
    return (sums[b.end] - sums[b.start] == size) & (size > 1)


def _features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    parts = [block_features(b, lexicon) for b in blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    forest: Forest
    knots: np.ndarray
    rates: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        return np.interp(self.forest.margin(_features(texts, self.lexicon)), self.knots, self.rates)


def training_rows(labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, toxic, half of at most ``rows`` labelled training rows: those of the lowest hash, so a fair sample."""
    return (
        labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(fold("doc_id", 4) != 2)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(rows)
        .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    )


def learn_lexicons(sample: DataFrame, size: int = LEXICON_SIZE) -> list[Lexicon]:
    """Lexicons of half 0, of half 1 and of all of ``sample`` (text, toxic, half)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = 2 * np.asarray(batch.column("half")) + np.asarray(batch.column("toxic"))
            found = [(block_forms(b), b.lo) for b in blocks(batch.column("text"))]
            forms = np.concatenate([f for (_, f), _ in found] or [np.zeros(0, np.uint64)])
            kinds = np.concatenate([kind[lo + d] for (d, _), lo in found] or [np.zeros(0, int)])
            form, which = np.unique(forms, return_inverse=True)
            n = np.bincount(which * 4 + kinds, minlength=4 * len(form)).reshape(-1, 4)
            yield pa.record_batch({"form": form.view(np.int64), **{f"n{k}": n[:, k] for k in range(4)}})

    kinds = [f"n{k}" for k in range(4)]
    sums = sample.mapInArrow(count, "form long, " + ", ".join(f"{k} long" for k in kinds)).groupBy("form").agg(*(F.sum(k).alias(k) for k in kinds))
    texts = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    out = []
    for halves in ((0,), (1,), (0, 1)):
        toxic, clean = (sum(F.col(f"n{2 * h + y}") for h in halves) for y in (1, 0))
        of = [max(1, sum(texts.get((h, y), 0) for h in halves)) for y in (1, 0)]
        ratio = ((toxic + 0.5) / (of[0] + 1)) / ((clean + 0.5) / (of[1] + 1))
        top = (
            sums.select("form", toxic.alias("toxic"), F.log(ratio).alias("weight"))
            .where((F.col("toxic") >= LEAST_TEXTS) & (F.col("weight") >= float(np.log(LEAST_RATIO))))
            .orderBy(F.col("toxic").desc(), F.col("weight").desc(), "form")
            .limit(size)
            .toArrow()
        )
        form = top["form"].to_numpy().view(np.uint64)
        order = np.argsort(form)
        out.append(Lexicon(form[order], top["weight"].to_numpy()[order]))
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    sample = id_and_text(docs).join(F.broadcast(training_rows(labels, rows)), "doc_id")
    lexicons = learn_lexicons(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            half = np.asarray(batch.column("half"))
            x = np.where((half == 0)[:, None], _features(batch.column("text"), lexicons[1]), _features(batch.column("text"), lexicons[0]))
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * FEATURES, x.ravel())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "x": flat, "y": batch.column("toxic")})

    found = sample.mapInArrow(measure, "doc_id long, x array<double>, y int").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    y = found["y"].to_numpy().astype(float)
    # calibrated on the margins that each fifth gets from trees fitted on the rest
    part = np.arange(len(y)) % 5
    margin = np.zeros(len(y))
    for k in range(5):
        margin[part == k] = fit_forest(x[part != k], y[part != k]).margin(x[part == k])
    return Model(lexicons[2], fit_forest(x, y), *fit_isotonic(margin, y))


def assess(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Null and empty texts have no hits and get the score that such features have; repeated rows score alike.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column("text"))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": score, "predicted": (score >= TOXIC_FROM).astype(np.int32)})

    rows = id_and_text(docs).withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return assess(docs, fit(docs, labels))
