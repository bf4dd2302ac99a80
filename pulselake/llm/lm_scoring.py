"""Language-model scores: a bigram model learned from the corpus, held as a weighted backoff automaton.

A document is its lower-case words and an end token. Every known word is a state; an arc from a state is a seen pair of
words, and a state's failure arc leads to the root, whose arcs are the single words. A traversal takes, for each token,
the arc of its state or else the failure arc and the root's arc, adds their weights, and is in the token's state then.
Pairs are smoothed with a Dirichlet prior of PRIOR virtual tokens spread like single words,
``p(w|h) = (c(hw) + PRIOR p(w)) / (c(h) + PRIOR)``, so the failure arc weighs ``PRIOR / (c(h) + PRIOR)``; single words
with absolute discounting, the discounted mass being that of unknown words.

No task and no message holds the model, which grows with the corpus. Texts are worked on in chunks of bounded size. A
chunk sends the sorted hashes of its distinct words and pairs, with its counts, to buckets of the hash range; a bucket
adds up and answers each chunk in the chunk's order; the chunk builds the part of the automaton that its own texts can
reach. A frequent pair is one entry per chunk, so no bucket grows with it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_and_text, written
from .text_arrays import blocks, mix

PRIOR = 300.0
#: Tokens of a chunk, about.
CHUNK_TOKENS = 2_000_000
#: Documents for each bucket of the hash range.
BUCKET_DOCUMENTS = 4_096

END = int(mix(np.array([0xE0D], np.uint64))[0])
BEGIN = int(mix(np.array([0xB09], np.uint64))[0])
#: Hash bits of a pair; words keep all 64.
PAIR_BITS = 56

_CHUNK = "chunk string, doc_ids binary, known_id binary, lengths binary, trained binary, held binary, words binary, tokens binary"
_SENT = "kind int, bucket int, chunk string, hashes binary, counts binary"
_ANSWER = "kind int, bucket int, chunk string, totals binary, tokens long, types long, once long, twice long"


def _squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    size = len(values)
    return size.to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _loose(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * size, "zstd", asbytes=True), np.uint8).reshape(8, size)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _sorted_squeezed(values: np.ndarray) -> bytes:
    """Ascending integers by their steps."""
    return _squeezed(np.diff(values, prepend=np.uint64(0)))


def _sorted_loose(raw: bytes) -> np.ndarray:
    return np.cumsum(_loose(raw), dtype=np.uint64)


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """Chunks of documents: ids, lengths, flags, the distinct words by falling frequency and the tokens as their places."""

    def pack(parts: list[tuple]) -> pa.RecordBatch:
        ids, lengths, trained, held, tokens = (np.concatenate([p[k] for p in parts]) for k in range(5))
        words, place, count = np.unique(tokens, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        known = np.array([i is not None for i in ids.tolist()], np.int64)
        numbers = np.array([i or 0 for i in ids.tolist()], np.int64).view(np.uint64)
        row = [uuid.uuid4().hex, _squeezed(numbers), _squeezed(known), _squeezed(lengths), _squeezed(trained), _squeezed(held), words[order].tobytes(), _squeezed(rank[place])]
        kinds = [pa.string()] + [pa.binary()] * 7
        return pa.record_batch([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        filled = 0
        for batch in batches:
            ids = np.array(batch.column("doc_id").to_pylist(), object)
            trained, held = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.int64) for c in ("trained", "held_out"))
            for b in blocks(batch.column("text")):
                n = np.diff(b.first)
                tokens = np.full(len(b.start) + len(n), END, np.uint64)
                tokens[np.arange(len(b.start)) + b.doc] = b.word_hash(lower=True)
                parts.append((ids[b.lo : b.hi], n + 1, trained[b.lo : b.hi], held[b.lo : b.hi], tokens))
                filled += len(tokens)
                if filled >= size:
                    yield pack(parts)
                    parts, filled = [], 0
        if parts:
            yield pack(parts)

    part = fold("doc_id", 7)
    rows = id_and_text(docs).select(
        "doc_id", "text", F.coalesce(part != 2, F.lit(False)).alias("trained"), F.coalesce(part == 2, F.lit(False)).alias("held_out")
    )
    return rows.mapInArrow(run, _CHUNK)


@dataclass
class Chunk:
    """The texts of a chunk as arrays. ``pair`` and ``word`` are each token's place among the sorted distinct hashes."""

    doc_ids: list
    held: np.ndarray
    ends: np.ndarray
    trained: np.ndarray
    words: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray
    context: np.ndarray

    def counts(self, what: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(what[self.trained], minlength=size)


def _chunk(row: dict) -> Chunk:
    by_rank = np.frombuffer(row["words"], np.uint64)
    order = np.argsort(by_rank)
    words = by_rank[order]
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    word = place[_loose(row["tokens"]).astype(np.int64)]
    ends = np.cumsum(_loose(row["lengths"]).astype(np.int64))
    tokens = words[word]
    before = np.append(np.uint64(BEGIN), tokens[:-1])
    before[ends[:-1]] = np.uint64(BEGIN)
    pairs, pair = np.unique(mix(before * np.uint64(0x9FB21C651E98DF25) + tokens) >> np.uint64(64 - PAIR_BITS), return_inverse=True)
    # a document begins as often as it ends, so the begin state has the end token's count
    context = np.append(np.searchsorted(words, np.uint64(END)), word[:-1])
    context[ends[:-1]] = context[0]
    known = _loose(row["known_id"])
    ids = [i if k else None for i, k in zip(_loose(row["doc_ids"]).view(np.int64).tolist(), known.tolist(), strict=True)]
    trained = np.repeat(_loose(row["trained"]).astype(bool), np.diff(ends, prepend=0))
    return Chunk(ids, _loose(row["held"]).astype(bool), ends, trained, words, word, pairs, pair, context)


def _edges(buckets: int, bits: int) -> np.ndarray:
    return np.array([k * (1 << bits) // buckets for k in range(1, buckets)], np.uint64)


def _sent(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _chunk(row)
                out = []
                for kind, hashes, places, bits in ((1, c.words, c.word, 64), (2, c.pairs, c.pair, PAIR_BITS)):
                    counts = c.counts(places, len(hashes))
                    cuts = [0, *np.searchsorted(hashes, _edges(buckets, bits)).tolist(), len(hashes)]
                    for b in range(buckets):
                        lo, hi = cuts[b], cuts[b + 1]
                        if lo < hi:
                            out.append((kind, b, row["chunk"], _sorted_squeezed(hashes[lo:hi]), _squeezed(counts[lo:hi])))
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _SENT.split(", ")])

    return chunks.mapInArrow(run, _SENT)


def _answers(sent: DataFrame) -> DataFrame:
    """Totals for each chunk and bucket, and, in a row without chunk, what the bucket's words add to the whole."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = [_sorted_loose(r["hashes"]) for r in rows]
        _, place = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(place, np.concatenate([_loose(r["counts"]) for r in rows]).astype(float)).astype(np.int64)
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        kind, bucket = rows[0]["kind"], rows[0]["bucket"]
        out = [(kind, bucket, r["chunk"], _squeezed(total[p]), 0, 0, 0, 0) for r, p in zip(rows, np.split(place, cuts), strict=True)]
        if kind == 1:
            out.append((kind, bucket, None, None, *(int(x) for x in (total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()))))
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.binary(), *[pa.int64()] * 4)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _ANSWER.split(", ")])

    return sent.groupBy("kind", "bucket").applyInArrow(run, _ANSWER)


@dataclass(frozen=True)
class Automaton:
    """The part of the model that a chunk reaches. States are the chunk's words.

    ``word`` are the weights of the root's arcs, ``pair`` those of the arcs of seen pairs (nan: no such arc), ``fail``
    those of the failure arcs; all in log10.
    """

    word: np.ndarray
    pair: np.ndarray
    fail: np.ndarray

    def traverse(self, word: np.ndarray, pair: np.ndarray, state: np.ndarray) -> np.ndarray:
        """The weight taken for each token, given the state before it and the arc that its pair would take."""
        arc = self.pair[pair]
        return np.where(np.isnan(arc), self.fail[state] + self.word[word], arc)


def automaton(words: np.ndarray, pairs: np.ndarray, context: np.ndarray, word_of_pair: np.ndarray, totals: dict, prior: float = PRIOR) -> Automaton:
    """From total counts of the chunk's words and pairs, each pair's context and last word, and the corpus figures."""
    n, types, once, twice = (totals[k] for k in ("tokens", "types", "once", "twice"))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    unknown = discount * types / n if n else 1.0
    p = np.where(words > 0, (words - discount) / max(n, 1), unknown)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.log10((pairs + prior * p[word_of_pair]) / (words[context] + prior))
    return Automaton(np.log10(p), np.where(pairs > 0, seen, np.nan), np.log10(prior / (words + prior)))


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, prior: float = PRIOR, chunk_tokens: int = CHUNK_TOKENS, bucket_documents: int = BUCKET_DOCUMENTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(doc_id) mod 7 is not 2; a null doc_id is neither learned from nor held out. Null and
    empty texts are the end token alone. Repeated rows count as often as they stand there. ``prior`` has no effect on
    base_score. Without training rows every word is unknown.
    """
    chunks = written(_chunks(docs, chunk_tokens), "chunks")
    buckets = max(1, math.ceil(docs.count() / bucket_documents))
    answers = written(_answers(_sent(chunks, buckets)), "answers")
    sums = answers.where("chunk IS NULL").agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("tokens", "types", "once", "twice")))
    totals = sums.first().asDict()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        c = _chunk(rows[0])
        told = sorted(right.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
        words, pairs = (np.concatenate([_loose(r["totals"]) for r in told if r["kind"] == k]).astype(np.int64) for k in (1, 2))
        one = np.zeros(len(pairs), np.int64)
        one[c.pair] = np.arange(len(c.pair))  # any token of each pair
        model = automaton(words, pairs, c.context[one], c.word[one], totals, prior)
        weight = model.traverse(c.word, c.pair, c.context)
        count = words[c.word]
        first = np.append(0, c.ends[:-1])
        tokens = c.ends - first
        base = np.add.reduceat(np.log10(count + 1.0), first) - tokens * math.log10(totals["tokens"] + totals["types"] + 1)
        known = np.add.reduceat((count > 0).astype(np.int64), first)
        train = np.full(len(tokens), totals["tokens"])
        columns = (c.doc_ids, c.held, tokens, known, train, base, np.add.reduceat(weight, first))
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    names = [x.split()[0] for x in _SCORES.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in _SCORES.split(", ")]
    replies = answers.where("chunk IS NOT NULL").select("chunk", "kind", "bucket", "totals")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, _SCORES)
