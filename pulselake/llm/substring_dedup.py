"""Removal of passages that an earlier document has, by repeated-phrase automata.

A window is WINDOW consecutive words of a document. Equal windows hold equal minimizers: the phrase of PHRASE words with
the lowest hash. So only phrases that are the minimizer of windows in two documents can lie in a recurring passage.

1. Each document names its minimizers; those that two different documents name recur. Copies of a whole text are set
   aside: all their windows start in the first of them.
2. Documents are dealt to shards. A shard gets the recurring phrases of its own documents, compiles them to one
   Aho-Corasick automaton and streams its documents through it; around each occurrence the windows are noted. Shards hold
   a bounded number of documents, so the automata stay small and each text is streamed once, however many phrases
   recur in the corpus.
3. Noted windows that start in two documents are confirmed, and their words go from all but the first of them.

Windows and phrases are known by 64-bit hashes of their words; the automata match the words themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .text_arrays import Block, blocks

WINDOW = 50
PHRASE = 8
#: Documents whose phrases share an automaton, on average.
SHARD_DOCUMENTS = 4_096

_NOTHING = hashlib.sha256(b"").hexdigest()


def _phrase_hashes(b: Block, words: np.ndarray) -> np.ndarray:
    """The hash of the phrase that starts at each word; the largest value where the text ends before the phrase does."""
    out = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    at = b.windows(PHRASE)
    out[at] = b.run_hash(words, at, at + PHRASE)
    return out


def minimizers(b: Block, window: int = WINDOW) -> list[np.ndarray]:
    """The distinct hashes of the phrases that are lowest in some window, for each text of the block."""
    words = b.word_hash()
    low, span = _phrase_hashes(b, words), window - PHRASE + 1
    reach = 1
    while 2 * reach <= span:
        low = np.append(np.minimum(low[:-reach], low[reach:]), low[len(low) - reach :]) if len(low) > reach else low
        reach *= 2
    at = b.windows(window)
    least = np.minimum(low[at], low[at + span - reach]) if len(at) else np.zeros(0, np.uint64)
    cut = np.searchsorted(b.doc[at], np.arange(b.hi - b.lo + 1))
    return [np.unique(least[cut[k] : cut[k + 1]]) for k in range(b.hi - b.lo)]


def _named(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, n_words, phrases (minimizers) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, counts = [], []
            for b in blocks(batch.column("text")):
                own += minimizers(b, window)
                counts += np.diff(b.first).tolist()
            at = np.cumsum([0] + [len(x) for x in own]).astype(np.int32)
            flat = np.concatenate(own or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "n_words": pa.array(counts, pa.int64()), "phrases": pa.ListArray.from_arrays(at, flat)}
            )

    keyed = id_and_text(docs).withColumn("text_key", F.sha2("text", 256))
    return keyed.mapInArrow(run, "doc_id long, text_key string, n_words long, phrases array<long>")


def _words(text: str) -> list[bytes]:
    """bytes.split parts at exactly the blanks that end words here."""
    return text.encode().split()


def _locate(texts: list[str], wanted: np.ndarray, window: int) -> list[np.ndarray]:
    """Starts of the windows around each occurrence of a wanted phrase, for each text, found by an automaton."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    if len(wanted):
        for b in blocks(pa.array(texts, pa.string())):
            hashes = _phrase_hashes(b, b.word_hash())
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            hits = np.flatnonzero((wanted[at] == hashes) & (hashes != np.iinfo(np.uint64).max))
            hits = hits[np.unique(hashes[hits], return_index=True)[1]]
            for k in hits.tolist():
                phrase = " ".join(bytes(b.data[s:e]).decode() for s, e in zip(b.start[k : k + PHRASE], b.end[k : k + PHRASE], strict=True))
                machine.add_word(f" {phrase} ", len(phrase) + 2)
    if not len(machine):
        return [np.zeros(0, np.int64)] * len(texts)
    machine.make_automaton()
    out = []
    for text in texts:
        words = [w.decode() for w in _words(text)]
        starts = np.cumsum([0] + [len(w) + 1 for w in words])[:-1]
        ends = [end - size + 1 for end, size in machine.iter(f" {' '.join(words)} ")] if len(words) >= window else []
        at = np.searchsorted(starts, np.array(ends, np.int64))
        cover = np.zeros(max(len(words) - window + 2, 1), np.int64)
        if len(at):
            np.add.at(cover, np.clip(at - (window - PHRASE), 0, len(cover) - 1), 1)
            np.add.at(cover, np.clip(at + 1, 0, len(cover) - 1), -1)
        out.append(np.flatnonzero(np.cumsum(cover[:-1]) > 0))
    return out


def _window_hashes(texts: list[str], at: list[np.ndarray], window: int) -> list[np.ndarray]:
    out = []
    for b in blocks(pa.array(texts, pa.string())):
        words = b.word_hash()
        for k in range(b.lo, b.hi):
            start = at[k] + b.first[k - b.lo]
            out.append(b.run_hash(words, start, start + window))
    return out


def _kept(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, str]:
    """How many words the windows at ``starts`` cover, and the digest of the others."""
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    gone = np.cumsum(cover[:-1]) > 0
    rest = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return int(gone.sum()), hashlib.sha256(rest).hexdigest()


_MARKED = "doc_id long, text_key string, n_words long, kept_sha256 string, text string, at array<int>, hashes array<long>"


def _marked(docs: DataFrame, phrases: DataFrame, copies: DataFrame, shards: int, window: int) -> DataFrame:
    """Documents without noted windows with their digest, the others with their text and windows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.sort(right["phrase"].drop_null().to_numpy().view(np.uint64))
        skipped = {(c["doc_id"], c["text_key"]) for c in right["copy"].drop_null().to_pylist()}
        given = zip(left["doc_id"].to_pylist(), left["text_key"].to_pylist(), left["text"].to_pylist(), strict=True)
        rows = {(i, key): t for i, key, t in given if (i, key) not in skipped}
        texts = list(rows.values())
        at = _locate(texts, wanted, window)
        hashes = _window_hashes(texts, at, window)
        words = [_words(t) for t in texts]
        none = [not len(a) for a in at]
        return pa.table(
            [
                pa.array([i for i, _ in rows], pa.int64()),
                pa.array([key for _, key in rows], pa.string()),
                pa.array(map(len, words), pa.int64()),
                pa.array([hashlib.sha256(b" ".join(w)).hexdigest() if n else None for w, n in zip(words, none, strict=True)], pa.string()),
                pa.array([None if n else t for t, n in zip(texts, none, strict=True)], pa.string()),
                pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64())),
            ],
            names=[c.split()[0] for c in _MARKED.split(", ")],
        )

    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    texts = id_and_text(docs).where("doc_id IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("text_key"), "text", shard)
    side = phrases.select("shard", "phrase", F.lit(None).cast("struct<doc_id: bigint, text_key: string>").alias("copy")).unionByName(
        copies.select(shard, F.lit(None).cast("long").alias("phrase"), F.struct("doc_id", "text_key").alias("copy"))
    )
    return texts.groupBy("shard").cogroup(side.groupBy("shard")).applyInArrow(run, _MARKED)


def _cleaned(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, text_key, n_words, n_removed, kept_sha256 of rows with text and ``gone``, the starts of windows that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(t) for t in batch.column("text").to_pylist()]
            found = [_kept(w, np.array(g or [], np.int64), window) for w, g in zip(words, batch.column("gone").to_pylist(), strict=True)]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "text_key": batch.column("text_key"),
                    "n_words": pa.array(map(len, words), pa.int64()),
                    "n_removed": pa.array([n for n, _ in found], pa.int64()),
                    "kept_sha256": pa.array([s for _, s in found], pa.string()),
                }
            )

    return rows.select("doc_id", "text_key", "text", "gone").mapInArrow(run, "doc_id long, text_key string, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Null and empty texts have no words. A null doc_id is neither smaller nor larger than another: such a row keeps all
    its words and takes none from others. Rows repeated with one doc_id and text get the same result each. Different texts
    under one doc_id are judged each by itself: windows that they share stay in both, as neither has the smaller doc_id.
    """
    named = written(_named(docs, window), "named")
    classes = written(named.where("doc_id IS NOT NULL").groupBy("text_key").agg(F.min("doc_id").alias("first_id")), "classes")
    of_class = named.join(classes, "text_key")
    shards = max(1, math.ceil(named.count() / shard_documents))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    phrases = of_class.where("doc_id = first_id").select("doc_id", shard, F.explode("phrases").alias("phrase"))
    recurring = phrases.groupBy("phrase").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("phrase")
    wanted = phrases.join(recurring, "phrase").select("shard", "phrase").distinct()
    copies = of_class.where("doc_id <> first_id").select("doc_id", "text_key").distinct()
    marked = written(_marked(docs, wanted, copies, shards, window), "marked")

    noted = marked.where("text IS NOT NULL")
    starts = noted.select("doc_id", "text_key", F.explode(F.arrays_zip("at", "hashes")).alias("w")).select("doc_id", "text_key", "w.at", "w.hashes")
    confirmed = starts.groupBy("hashes").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("hashes", "low")
    gone = starts.join(confirmed, "hashes").where("doc_id > low").groupBy("doc_id", "text_key").agg(F.collect_list("at").alias("gone"))
    firsts = (
        _cleaned(noted.select("doc_id", "text_key", "text").join(gone, ["doc_id", "text_key"], "left"), window)
        .unionByName(marked.where("text IS NULL").select("doc_id", "text_key", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256"))
        .withColumnRenamed("doc_id", "first_id")
        .drop("n_words")
    )
    whole = F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("first_id")) & (F.col("n_words") >= window)
    result = of_class.where("doc_id IS NOT NULL").join(firsts, ["first_id", "text_key"]).select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(_NOTHING)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    nameless = id_and_text(docs).where("doc_id IS NULL").withColumn("text_key", F.sha2("text", 256)).withColumn("gone", F.array().cast("array<int>"))
    return result.unionByName(_cleaned(nameless, window).drop("text_key"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+49], ' ') AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)
), gone AS (
  SELECT doc_id, list(i) AS starts
  FROM (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY x) AS later FROM windows)
  WHERE later GROUP BY doc_id
), covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS k FROM (SELECT doc_id, unnest(starts) AS s FROM gone)
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM words
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.k) AS rest, count(*) AS n
  FROM each e ANTI JOIN covered c ON e.doc_id = c.doc_id AND e.k = c.k GROUP BY e.doc_id
)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
