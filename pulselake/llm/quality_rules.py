"""Quality rules: boosted trees over document statistics, besides two fixed rules.

One pass over whole texts turns each into some twenty statistics (numpy over the text bytes, see ``text_arrays``). The
trees are fitted on a bounded sample of labelled rows and held as flat node arrays, a few kilobytes that each task
uses on whole batches. Statistics of which more is never better may only lower the verdict (monotonic constraints).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosted_trees import Forest, fit_forest
from .common import id_and_text
from .text_arrays import BLANK, Block, blocks

#: The trees see at most this many labelled rows, those with the lowest hash of doc_id.
TRAINING_ROWS = 20_000
#: Least probability of label 1 with which a document stays.
KEEP_FROM = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature and the direction it may move the verdict in.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_rate": -1,
    "dup_line_rate": -1,
    "repeat_rate": -1,
    "upper_rate": -1,
    "digit_rate": 0,
    "punctuation_rate": 0,
    "bang_rate": -1,
    "bar_rate": -1,
    "wide_rate": 0,
    "distinct_rate": 0,
    "repeat_next_rate": -1,
    "short_rate": 0,
    "words_per_line": 0,
    "lines": 0,
    "stops_per_word": 0,
    "log_longest_word": -1,
    "control_rate": -1,
}
MONOTONE = np.array(list(FEATURES.values()))


def _bytes(chars: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(chars.encode())] = True
    return mask


_SYMBOL = _bytes("#*$%&|<>")
_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _bytes("0123456789")
_PUNCTUATION = _bytes(".,;:!?\"'()[]{}-_/\\@^~`+=")
_STOP = _bytes(".!?")
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_CONTROL = (np.arange(256) < 32) & ~BLANK


def block_statistics(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """The counts of COUNTS and the features of FEATURES for the texts of a block."""
    n, data = b.hi - b.lo, b.data
    words = np.diff(b.first)
    chars = b.counts(~_CONTINUES[data])
    word_chars = b.counts(~_CONTINUES[data] & ~BLANK[data])
    hashes = b.word_hash()

    # lines: pieces between "\n" and text borders that hold a word
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(b.at[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), len(data))
    doc = np.searchsorted(b.at, starts, "right") - 1
    at_end = ends == b.at[doc + 1]
    stops = np.where(at_end & ~((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10)), ends, ends - 1)
    holds = np.searchsorted(b.start, stops) > np.searchsorted(b.start, starts)
    doc, line = doc[holds], b.span_hash(starts[holds], stops[holds])
    lines = np.bincount(doc, minlength=n)
    dup_lines = lines - _distinct(doc, line, n)

    # words within three-word windows that occur at least twice in their text
    at = b.windows(3)
    repeat_words = np.zeros(n, np.int64)
    if len(at):
        window, own = b.run_hash(hashes, at, at + 3), b.doc[at]
        order = np.lexsort((window, own))
        same = (window[order][1:] == window[order][:-1]) & (own[order][1:] == own[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        cover = np.zeros(len(b.doc) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + 3, -1)
        repeat_words = np.bincount(b.doc[np.cumsum(cover[:-1]) > 0], minlength=n)

    symbols = b.counts(_SYMBOL[data])
    size, some, some_chars = b.end - b.start, np.maximum(words, 1), np.maximum(chars, 1)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, b.doc, size)
    next_same = np.zeros(n, np.int64)
    if len(hashes) > 1:
        next_same = np.bincount(b.doc[1:][(hashes[1:] == hashes[:-1]) & (b.doc[1:] == b.doc[:-1])], minlength=n)
    features = [
        np.log1p(words),
        word_chars / some,
        symbols / some_chars,
        dup_lines / np.maximum(lines, 1),
        repeat_words / some,
        b.counts(_UPPER[data]) / some_chars,
        b.counts(_DIGIT[data]) / some_chars,
        b.counts(_PUNCTUATION[data]) / some_chars,
        b.counts(data == 33) / some_chars,
        b.counts(data == 124) / some_chars,
        b.counts(data >= 0xC0) / some_chars,
        _distinct(b.doc, hashes, n) / some,
        next_same / some,
        np.bincount(b.doc[size <= 3], minlength=n) / some,
        words / np.maximum(lines, 1),
        np.log1p(lines),
        b.counts(_STOP[data]) / some,
        np.log1p(longest),
        b.counts(_CONTROL[data]) / some_chars,
    ]
    return np.stack([words, word_chars, symbols, dup_lines, repeat_words], axis=1), np.stack(features, axis=1)


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values in each text."""
    if not len(doc):
        return np.zeros(n, np.int64)
    order = np.lexsort((value, doc))
    v, d = value[order], doc[order]
    new = np.append(True, (v[1:] != v[:-1]) | (d[1:] != d[:-1]))
    return np.bincount(d[new], minlength=n)


def _statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [block_statistics(b) for b in blocks(texts)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents; the ids sent to the tasks are as many."""
    chosen = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(rows)
    )
    labelled = id_and_text(docs).join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _statistics(batch.column("text"))[1]
            flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "x": flat, "y": batch.column("quality")})

    found = labelled.mapInArrow(measure, "doc_id long, x array<double>, y int").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return x, found["y"].to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Forest:
    x, y = training_sample(docs, labels, rows)
    return fit_forest(x, y, MONOTONE)


def _verdicts(texts: pa.Array, model: Forest, keep_from: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed, quality, kept of each text."""
    counts, x = _statistics(texts)
    words, repeats = counts[:, 0], counts[:, 4]
    failed = (words < 50) | (100 * repeats > 50 * words)
    quality = model.probability(x)
    return counts, failed, quality, ~failed & (quality >= keep_from)


def kept_documents(docs: DataFrame, model: Forest, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged. Needs no shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_verdicts(batch.column("text"), model, keep_from)[3]))

    return docs.mapInArrow(keep, docs.schema)


def assess(docs: DataFrame, model: Forest, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, quality (probability of label 1), kept.

    Null and empty texts have no words, so they fail the base rules and go. Repeated rows are judged alike.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, quality, kept = _verdicts(batch.column("text"), model, keep_from)
            columns = {name: counts[:, k] for k, name in enumerate(COUNTS)}
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), **columns, "base_failed": failed, "quality": quality, "kept": kept}
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean"
    return id_and_text(docs).mapInArrow(judge, schema)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return assess(docs, fit(docs, labels))
