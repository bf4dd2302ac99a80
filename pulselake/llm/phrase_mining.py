"""Phrase collocations of each language, by Apriori levels over double-array tries.

1. Each task cuts texts into pieces and words, and keeps them as numbers of words with marks between pieces. Words are
   counted; those of at least ``least`` occurrences are numbered, all others end a phrase.
2. Level by level, a phrase of k words is only looked for where its first and its last k - 1 words are both frequent: where
   the states of two neighbouring positions accept. A task gives such pairs local numbers, counts them by bincount, and
   the tasks' counts are summed bucket by bucket. Frequent ones become the next level of the trie.
3. The level's transitions (phrase, phrase one word on) are a double-array trie over the bytes of the latter's number. It is
   broadcast, and numpy moves the states of all positions of a block through it at once. A trie holds a bounded number of
   transitions (TRIE_EDGES); a level with more is spread over several tries, applied one after another. Only the newest
   states are kept.

Nothing but tries, one at a time, goes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, importable, rows_a_batch, written
from .tokens import byte_class, token_blocks

LEAST = 100
LONGEST = 5
TOP = 2_000
#: Transitions in a trie, and words in a broadcast list of words, on average.
TRIE_EDGES = 1 << 20
#: Nodes with more children have a stretch of the array of their own, whose gaps others fill.
CROWDED = 24
#: Bytes of text in a block.
BLOCK_BYTES = 1 << 20
#: Blocks, each of about BLOCK_BYTES, that go to a Python worker at once.
BATCH_BLOCKS = 8
#: Pairs that a task gathers before it passes their counts on, and that a bucket sums, on average at most.
GATHERED = 1 << 18
BUCKET_PAIRS = 1 << 19

#: Bytes that end a piece: . , ; : ! ? and line ends.
PIECE_END = byte_class(*b".,;:!?", range(0x0A, 0x0E))
WORD = ~(PIECE_END | byte_class(0x20, 0x09))

BLOCKS = "lang string, size long, words array<string>, counts array<long>, codes binary"
STATES = "states binary"


def _cell(*columns: np.ndarray) -> bytes:
    """Numbers as compressed bytes: executors move and hold what is a fraction of the arrays."""
    raw = b"".join(x.tobytes() for x in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(cell: bytes) -> bytes:
    return pa.decompress(cell[8:], decompressed_size=int.from_bytes(cell[:8], "little"), codec="zstd", asbytes=True)


def _numbers(cell: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(_opened(cell), kind)


def _segments(texts: pa.Array) -> pa.Array:
    """The same texts, those over BLOCK_BYTES cut where pieces end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or int(np.diff(at).max()) <= BLOCK_BYTES:
        return texts
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    cuts = [at]
    for k in np.flatnonzero(np.diff(at) > BLOCK_BYTES).tolist():
        ends = at[k] + np.flatnonzero(PIECE_END[data[at[k] : at[k + 1]]])
        near = np.searchsorted(ends, np.arange(at[k] + BLOCK_BYTES, at[k + 1], BLOCK_BYTES))
        cuts.append(ends[near[near < len(ends)]])
    at = np.unique(np.concatenate(cuts))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), texts.buffers()[2])


def blocks_of_words(docs: DataFrame) -> DataFrame:
    """Blocks of texts of one language (null: ``und``): distinct words with their counts, and ``codes``, the texts as places
    in ``words`` (int32, compressed) with -1 between pieces; ``size`` is the number of words with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique():
                own = _segments(batch.column("text").filter(pc.equal(langs, lang)))
                for t in token_blocks(own, WORD, BLOCK_BYTES):
                    if not len(t.words):
                        continue
                    coded = t.words.dictionary_encode()
                    codes = coded.indices.to_numpy()
                    ends = np.flatnonzero(PIECE_END[t.data])
                    before = np.searchsorted(ends, t.start)  # piece ends before each word
                    apart = (t.text[1:] != t.text[:-1]) | (before[1:] > before[:-1])
                    spread = np.full(len(codes) + int(apart.sum()), -1, np.int32)
                    spread[np.arange(len(codes)) + np.append(0, np.cumsum(apart))] = codes
                    words = coded.dictionary.cast(pa.string())
                    whole = [0, len(words)]
                    yield pa.record_batch(
                        {
                            "lang": pa.array([lang.as_py()]),
                            "size": pa.array([len(codes)], pa.int64()),
                            "words": pa.ListArray.from_arrays(whole, words),
                            "counts": pa.ListArray.from_arrays(whole, np.bincount(codes, minlength=len(words))),
                            "codes": pa.array([_cell(spread)]),
                        }
                    )
                del own
            pa.default_memory_pool().release_unused()

    importable(docs.sparkSession)
    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, BLOCKS)


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df``, written, with ``id`` from 0 without gaps; and how many rows there are."""
    held = written(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = held.groupBy(part.alias("_part")).count().collect()  # a row per partition
    first, total = [], 0
    for p, n in sorted(sizes):
        first.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(first, "_part long, _first long")
    placed = held.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("id", F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_first", "_at"), total


def _size_of_ids(n: int) -> np.dtype:
    return np.dtype(np.int32 if n < 1 << 31 else np.int64)


def _with_words(blocks: DataFrame, words: DataFrame, shards: int, ids: np.dtype) -> DataFrame:
    """The blocks as states of level 1: the numbers of frequent words, -1 for others and between pieces."""
    spark = blocks.sparkSession

    def mapping(shared: Broadcast, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(len(batch)):
                    row = batch[k : k + 1]
                    words = row.column("words").flatten()
                    to = np.full(len(words), -1, ids) if first else _numbers(row.column("to")[0].as_py(), ids).copy()
                    own = shared.value.get(row.column("lang")[0].as_py())
                    if own:
                        found = pc.index_in(words, value_set=own[0])
                        hit = np.asarray(found.is_valid())
                        to[hit] = own[1][found.drop_null().to_numpy()]
                    if last:
                        codes = _numbers(row.column("codes")[0].as_py(), np.dtype(np.int32))
                        yield pa.record_batch({"states": pa.array([_cell(np.append(to, -1).astype(ids)[codes])])})
                    else:
                        yield row.append_column("to", pa.array([_cell(to)])) if first else row.set_column(len(row.schema) - 1, "to", pa.array([_cell(to)]))

        return run

    at = blocks
    for k in range(shards):
        known = words.where(F.pmod(F.xxhash64("lang", "word"), F.lit(shards)) == k).select("lang", "word", "id").toArrow()
        lists = {lang.as_py(): known.filter(pc.equal(known["lang"], lang)).combine_chunks() for lang in known["lang"].unique()}
        shared = spark.sparkContext.broadcast({lang: (t["word"].combine_chunks(), t["id"].to_numpy()) for lang, t in lists.items()})
        last = k == shards - 1
        given = at.select("lang", "words", "codes", *["to"] * bool(k))
        with rows_a_batch(spark, BATCH_BLOCKS):
            now = written(given.mapInArrow(mapping(shared, not k, last), STATES if last else "lang string, words array<string>, codes binary, to binary"), "states")
        shared.destroy()
        discard(at)
        at = now
    return at


def local_counts(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, in order, and the sum of ``n`` over each."""
    if a.dtype == np.int32:
        pairs, number = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        left, right = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
    else:
        (lefts, i), (rights, j) = (np.unique(x, return_inverse=True) for x in (a, b))
        pairs, number = np.unique(i * np.int64(max(len(rights), 1)) + j, return_inverse=True)
        left, right = lefts[pairs // max(len(rights), 1)], rights[pairs % max(len(rights), 1)]
    return left, right, np.bincount(number, n, len(pairs)).astype(np.int64)


def _unpacked(cell: bytes, ids: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a (kept as steps), b and n of pairs."""
    data = _opened(cell)
    many = len(data) // (2 * ids.itemsize + 8)
    a, b = (np.frombuffer(data, ids, many, k * many * ids.itemsize) for k in (0, 1))
    return np.cumsum(a, dtype=ids), b, np.frombuffer(data, np.int64, many, 2 * many * ids.itemsize)


def pair_counts(states: DataFrame, ids: np.dtype, buckets: int, least: int) -> DataFrame:
    """a, b, n: accepting state b follows accepting state a at the next position n times, ``least`` or more."""

    def passed_on(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b, n = local_counts(*(np.concatenate(c) for c in zip(*held, strict=True)))
        bucket = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)
        bucket = (bucket % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        own, first = np.unique(bucket[order], return_index=True)
        rows = [_cell(np.diff(a[at], prepend=a.dtype.type(0)), b[at], n[at]) for at in np.split(order, first[1:])]
        if len(own):
            yield pa.record_batch({"bucket": pa.array(own), "pairs": pa.array(rows, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for row in batch.column("states"):
                s = _numbers(row.as_py(), ids)
                at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
                held.append(local_counts(s[at], s[at + 1], np.ones(len(at), np.int64)))
                many += len(held[-1][0])
                if many >= GATHERED:
                    yield from passed_on(held)
                    held, many = [], 0
        if held:
            yield from passed_on(held)

    def summed(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
        a, b, n = local_counts(*(np.concatenate(c) for c in zip(*(_unpacked(x.as_py(), ids) for x in group["pairs"]), strict=True)))
        own = n >= least
        return pa.table({"a": a[own].astype(np.int64), "b": b[own].astype(np.int64), "n": n[own]})

    return states.mapInArrow(run, "bucket int, pairs binary").groupBy("bucket").applyInArrow(summed, "a long, b long, n long")


class DoubleArray:
    """A trie over sequences of bytes, many walked at once.

    Node t has the child by byte x at ``base[t] + x`` if ``check`` of that place is t. Sequence k starts at the
    node of its head, ``heads`` sorted, and ends at a node whose ``value`` is its number.
    """

    def __init__(self, heads: np.ndarray, base: np.ndarray, check: np.ndarray, value: np.ndarray, digits: int):
        self.heads, self.base, self.check, self.value, self.digits = heads, base, check, value, digits

    @classmethod
    def build(cls, head: np.ndarray, symbol: np.ndarray, value: np.ndarray) -> DoubleArray:
        """Of distinct (head, symbol); values are at least 0."""
        digits = max(1, (int(symbol.max()).bit_length() + 7) // 8) if len(symbol) else 1
        order = np.lexsort((symbol, head))
        head, symbol, value = head[order], symbol[order], value[order]
        heads, owner = np.unique(head, return_inverse=True)
        places = _Places(len(heads), len(symbol))
        node = owner  # the node that each sequence has reached; heads are the first nodes
        for d in range(digits - 1, -1, -1):
            byte = symbol >> 8 * d & 255
            new = np.append(True, (node[1:] != node[:-1]) | (byte[1:] != byte[:-1]))[: len(symbol)]
            children = places.put(node[new], byte[new])
            node = children[np.cumsum(new) - 1]
        base, check = places.arrays()
        values = np.full(len(base), -1, np.int64)
        values[node] = value
        return cls(heads, base, check, values, digits)

    def walk(self, head: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The number of each (head, symbol), or -1; negative ones are nowhere."""
        at = np.minimum(np.searchsorted(self.heads, head), max(len(self.heads) - 1, 0))
        alive = np.flatnonzero((self.heads[at] == head) & (symbol >= 0) & (symbol >> 8 * self.digits == 0)) if len(self.heads) else np.zeros(0, np.int64)
        node, symbol = at[alive], symbol[alive]
        for d in range(self.digits - 1, -1, -1):
            to = self.base[node] + (symbol >> 8 * d & 255)
            on = self.check[to] == node
            alive, node, symbol = alive[on], to[on], symbol[on]
        out = np.full(len(head), -1, np.int64)
        out[alive] = self.value[node]
        return out


class _Places:
    """Where nodes of a double array lie. Nodes with many children come first, each in a stretch of its own; the children of
    others go where all their places are free, found for many nodes in one step."""

    def __init__(self, heads: int, sequences: int):
        self.random = np.random.default_rng(heads + sequences)
        self.base = np.zeros(heads + 256, np.int64)
        self.check = np.full(heads + 256, -1, np.int64)
        self.check[:heads] = -2  # heads are nobody's children
        self.end = heads

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, len(self.check) * 3 // 2) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def put(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Places of the children (node, byte); rows of a node stand together."""
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
        degree = np.diff(np.append(first, len(node)))
        places = np.zeros(len(node), np.int64)
        crowded = np.flatnonzero(degree > CROWDED)
        starts = self.end + 256 * np.arange(len(crowded))
        self._settle(crowded, starts, first, degree, node, byte, places)
        low = self.end
        room = int(1.5 * len(node)) + 512
        self._grow(max(self.end, low + room) + 512)
        for size in range(CROWDED, 0, -1):
            left = np.flatnonzero(degree == size)
            for _ in range(40):
                if not len(left):
                    break
                free = np.flatnonzero(self.check[: low + room] == -1)
                lead = free[self.random.integers(0, len(free), len(left))] if size > 1 or len(free) < len(left) else self.random.permutation(free)[: len(left)]
                start = lead - byte[first[left]]
                rows = first[left][:, None] + np.arange(size)
                to = start[:, None] + byte[rows]
                fits = (start >= 0) & (to < len(self.check)).all(axis=1)
                fits[fits] = (self.check[to[fits]] == -1).all(axis=1)
                claim = np.full(len(self.check), -1, np.int64)
                some = np.flatnonzero(fits)
                claim[to[some].ravel()] = np.repeat(some, size)
                won = some[(claim[to[some]] == some[:, None]).all(axis=1)]
                self._settle(left[won], start[won], first, degree, node, byte, places)
                left = np.delete(left, won)
            starts = max(self.end, low + room) + 256 * np.arange(len(left))
            self._settle(left, starts, first, degree, node, byte, places)
        return places

    def _settle(self, which: np.ndarray, start: np.ndarray, first: np.ndarray, degree: np.ndarray, node: np.ndarray, byte: np.ndarray, places: np.ndarray) -> None:
        if not len(which):
            return
        size = degree[which]
        rows = np.repeat(first[which] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
        to = np.repeat(start, size) + byte[rows]
        self._grow(int(to.max()) + 256)
        self.base[node[first[which]]] = start
        self.check[to] = node[rows]
        places[rows] = to
        self.end = max(self.end, int(to.max()) + 1)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        size = self.end + 256  # a step from any node stays inside
        self._grow(size)
        kind = np.int32 if size < 1 << 31 else np.int64
        return self.base[:size].astype(kind), self.check[:size].astype(kind)


TRIE = "heads binary, base binary, check binary, value binary, digits int"


def tries(level: DataFrame, shards: int) -> DataFrame:
    """The double-array tries of a level's transitions (a, b, id), a row per shard."""

    def run(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
        t = DoubleArray.build(*(group[c].to_numpy() for c in ("a", "b", "id")))
        arrays = [pa.array([x.tobytes()]) for x in (t.heads, t.base.astype(np.int64), t.check.astype(np.int64), t.value)]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *arrays, pa.array([t.digits], pa.int32())], ["shard", *(c.split()[0] for c in TRIE.split(", "))])

    shard = F.pmod(F.xxhash64("a", "b"), F.lit(shards)).cast("int").alias("shard")
    return level.select("a", "b", "id", shard).groupBy("shard").applyInArrow(run, f"shard int, {TRIE}")


def _advanced(states: DataFrame, built: DataFrame, shards: int, ids: np.dtype) -> DataFrame:
    """States of phrases from those of one word less, which are discarded."""
    spark = states.sparkSession

    def step(shared: Broadcast, first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = DoubleArray(*shared.value)
            for batch in batches:
                for k in range(len(batch)):
                    given = batch.column("states")[k].as_py()
                    old = _numbers(given, ids)
                    new = np.full(len(old), -1, ids) if first else _numbers(batch.column("next")[k].as_py(), ids).copy()
                    at = np.flatnonzero((old[:-1] >= 0) & (old[1:] >= 0))
                    to = trie.walk(old[at], old[at + 1])
                    new[at[to >= 0]] = to[to >= 0]
                    cells = {"states": _cell(new)} if last else {"states": given, "next": _cell(new)}
                    yield pa.record_batch({c: pa.array([v]) for c, v in cells.items()})

        return run

    for k in range(shards):
        row = next(iter(built.where(F.col("shard") == k).toArrow().to_pylist()), {c: b"" for c in ("heads", "base", "check", "value")} | {"digits": 1})
        arrays = [np.frombuffer(row[c], np.int64) for c in ("heads", "base", "check", "value")]
        small = [x.astype(np.int32) if len(arrays[1]) < 1 << 31 else x for x in arrays[1:3]]
        shared = spark.sparkContext.broadcast((arrays[0], *small, arrays[3], row["digits"]))
        last = k == shards - 1
        with rows_a_batch(spark, BATCH_BLOCKS):
            now = written(states.mapInArrow(step(shared, not k, last), STATES if last else f"{STATES}, next binary"), "states")
        shared.destroy()
        discard(states)
        states = now
    return states


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, trie_edges: int = TRIE_EDGES) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of 1, 2, ... words, and lang, total: the words of each language with repeats.

    Of each phrase: id, lang, phrase, last (its last word), n (occurrences), heads and tails (occurrences of its first and of
    its last 1, 2, ... words); from two words on a and b, the ids of the phrases without the last and the first word, one
    level below.
    """
    blocks = written(blocks_of_words(docs), "blocks")
    totals = written(blocks.groupBy("lang").agg(F.sum("size").alias("total")), "totals")
    buckets = max(1, math.ceil((totals.agg(F.sum("total")).first()[0] or 0) / BUCKET_PAIRS))
    words = blocks.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    level, many = numbered(words, "words")
    level = written(level, "phrases")
    ids = _size_of_ids(many)
    states = _with_words(blocks, level, max(1, math.ceil(many / trie_edges)), ids)
    levels = [level.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", F.array("n").alias("heads"), F.array("n").alias("tails"))]
    for length in range(2, longest + 1):
        below = levels[-1]
        with rows_a_batch(docs.sparkSession, BATCH_BLOCKS):
            level, many = numbered(pair_counts(states, ids, buckets, least), "pairs")
        if not many:
            break
        front = below.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("front"), "heads")
        back = below.select(F.col("id").alias("b"), "last", "tails")
        n = F.array("n")
        level = level.join(front, "a").join(back, "b").select(
            "id", "lang", F.concat_ws(" ", "front", "last").alias("phrase"), "last", "n", F.concat("heads", n).alias("heads"), F.concat("tails", n).alias("tails"), "a", "b"
        )
        level = written(level, "phrases")
        levels.append(level)
        if length < longest:
            if _size_of_ids(many) != ids:
                raise OverflowError(f"{many} phrases of {length} words have no numbers of {ids}")
            shards = max(1, math.ceil(many / trie_edges))
            states = _advanced(states, written(tries(level, shards), "tries"), shards, ids)
    discard(states)
    return levels, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, trie_edges: int = TRIE_EDGES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language.

    Words are runs without blanks in pieces between . , ; : ! ? and line ends, A-Z lower-cased. A null lang is ``und``; null
    and empty texts have no words; repeated rows count each. Languages without a frequent phrase of two words, and
    no documents, have no rows.
    """
    levels, totals = frequent_phrases(docs, least, longest, trie_edges)
    found = None
    for k in range(1, len(levels)):
        own = levels[k].select("id", "lang", "phrase", "n", "heads", "tails")
        if k + 1 < len(levels):
            longer = levels[k + 1]
            same = longer.select(F.col("a").alias("id"), "n").unionByName(longer.select(F.col("b").alias("id"), "n")).distinct()
            own = own.join(same, ["id", "n"], "left_anti")  # of a longer phrase, just as frequent, some one word longer part is too
        found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank int, phrase string, a long, l long, r long, n long, score long")
    cut = """array_min(transform(sequence(1, size(heads) - 1), k -> named_struct(
        'score', (1000 * cast(n AS decimal(19,0)) * cast(total AS decimal(19,0))) div (cast(heads[k - 1] AS decimal(19,0)) * cast(tails[size(heads) - k - 1] AS decimal(19,0))),
        'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k - 1])))"""
    scored = found.join(totals, "lang").withColumn("cut", F.expr(cut))
    window = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("n"), "phrase")
    return (
        scored.withColumn("rank", F.row_number().over(window))
        .where(F.col("rank") <= top)
        .select("lang", "rank", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")
    )


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, w[i:i+k-1] AS x, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, x, f AS a FROM f WHERE len(x) > 1),
inner_ AS (
  SELECT DISTINCT lang, x[i:i+k-1] AS x, a
  FROM (SELECT lang, x, a, k, unnest(generate_series(1, len(x) - k + 1)) AS i FROM c, (SELECT unnest([2, 3, 4]) AS k) WHERE k < len(x))
), kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_ o WHERE o.lang = c.lang AND o.x = c.x AND o.a >= c.a)),
cuts AS (SELECT lang, x, a, unnest(generate_series(1, len(x) - 1)) AS k FROM kept),
scores AS (
  SELECT u.lang, u.x, u.a, u.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * u.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts u JOIN t USING (lang) JOIN f l ON l.lang = u.lang AND l.x = u.x[:u.k] JOIN f r ON r.lang = u.lang AND r.x = u.x[u.k+1:]
), lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1)
SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(x, ' ')))::INTEGER AS rank,
  array_to_string(x, ' ') AS phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
