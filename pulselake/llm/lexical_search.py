"""Ranked lexical search: the best documents of every item of a query set, by a dual-tree search.

A document is a sparse vector over the items' terms (how much a term in it counts), an item one of the weights of its
terms; a score is their inner product, in integers.

1. One pass over the documents keeps, of each, its length and how often it has terms of the items. From that come the
   numbers of documents, of terms and of documents with a term.
2. Each task searches its documents in batches. Both sides are put into hierarchies, items once and documents per batch,
   whose nodes hold the maximum of each coordinate. The inner product of two nodes' maxima bounds every score between
   them; a pair of nodes goes as a whole if its bound is below the weakest of the kth scores of the node's items. What
   is left is scored. Bounds are exact, so no result is lost.
3. The tasks' best are merged, first within groups of tasks, then per item.

Items are searched in blocks, so that what a task holds and what is broadcast are bounded (BLOCK_CELLS), however many
items there are; with few items there is one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, written
from .tokens import byte_class, token_blocks

TOP = 20
#: Cells of the matrix of a block of items and their terms, and of a batch of documents and those terms, on average.
BLOCK_CELLS = 1 << 22
#: Children of a node of either hierarchy.
FAN = 8
#: Groups of rows whose best are found apart before those of an item meet.
MERGE_GROUPS = 64

#: Bytes of a term: digits, letters and all of non-ASCII characters.
TERM = byte_class(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100))

VECTORS = "doc_id long, n long, codes array<int>, counts array<long>"
FOUND = "item int, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and terms, with repeats, of each row of ``items``; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in token_blocks(batch.column("text"), TERM):
                at = np.searchsorted(t.text, np.arange(t.hi - t.lo + 1)).astype(np.int32)
                yield pa.record_batch({"item_id": batch.column("item_id")[t.lo : t.hi], "terms": pa.ListArray.from_arrays(at, t.words.cast(pa.string()))})

    importable(items.sparkSession)
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "item_id long, terms array<string>")


def vectors(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """Of each row with a term: doc_id, n (its terms with repeats), and codes (places in ``terms``) with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in token_blocks(batch.column("text"), TERM):
                code = pc.index_in(t.words, value_set=terms)
                known = np.flatnonzero(np.asarray(code.is_valid()))
                key = t.text[known] * max(len(terms), 1) + code.drop_null().to_numpy()
                key, many = np.unique(key, return_counts=True)
                size = np.bincount(t.text, minlength=t.hi - t.lo)
                some = np.flatnonzero(size)
                at = np.append(np.searchsorted(key, some * max(len(terms), 1)), len(key)).astype(np.int32)
                codes = (key % max(len(terms), 1)).astype(np.int32)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column("doc_id")[t.lo : t.hi].take(pa.array(some)),
                        "n": pa.array(size[some].astype(np.int64)),
                        "codes": pa.ListArray.from_arrays(at, codes),
                        "counts": pa.ListArray.from_arrays(at, many.astype(np.int64)),
                    }
                )

    importable(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, VECTORS)


def term_weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """100 - 25 + ((25 n N) div L); in Python's integers where 64 bits might not hold the product."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * int(x) * documents // terms for x in n], np.int64)
    return 75 + 25 * n * documents // max(terms, 1)


def term_value(counts: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 12 * norm)


@dataclass
class Level:
    """Nodes of a hierarchy: node k has the rows ``k * width`` to ``(k + 1) * width`` and their maxima."""

    width: int
    maxima: np.ndarray


def hierarchy(rows: np.ndarray) -> list[Level]:
    """From few wide nodes to the rows themselves."""
    levels = [Level(1, rows)]
    while len(levels[0].maxima) > FAN:
        below = levels[0]
        levels.insert(0, Level(below.width * FAN, np.maximum.reduceat(below.maxima, np.arange(0, len(below.maxima), FAN), axis=0)))
    return levels


def likeness(matrix: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """An order of rows that brings like ones together: by their most usual term, then by their most telling one."""
    if not matrix.size:
        return np.arange(len(matrix))
    usual = np.argmin(np.where(matrix > 0, weights, np.inf), axis=1)
    return np.lexsort((np.argmax(matrix * weights, axis=1), usual))


class Search:
    """The best documents so far of each item, over batches of documents."""

    def __init__(self, queries: np.ndarray, weights: np.ndarray, top: int = TOP):
        """``queries``: for each item and term, the term's weight times its count in the item."""
        self.weights, self.top = weights, top
        self.items = likeness((queries > 0).astype(float), weights)
        self.tree = hierarchy(queries[self.items])
        self.best = np.zeros((3, 0), np.int64)  # item, score, row number
        self.ids: list[int | None] = []
        self.kth = np.ones(len(queries), np.int64)  # what a score must reach, in the tree's order
        self.scored = self.pairs = 0

    def add(self, ids: list[int | None], values: np.ndarray) -> None:
        """Search a batch of documents; ``values``: for each document and term, how much the term counts."""
        order = likeness(values, self.weights)
        docs = hierarchy(values[order])
        self.pairs += len(self.kth) * len(ids)
        for root in range(len(docs[0].maxima)):
            items, rows, scores = self._descend(docs, root)
            if len(items):
                self._take(items, order[rows], scores, ids)

    def _descend(self, docs: list[Level], root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, documents and scores that reach the items' kth scores, below one of the documents' widest nodes."""
        open_ = np.ones((len(self.tree[0].maxima), 1), bool)
        nodes = np.array([root])
        mine = 0
        for depth in range(max(len(docs), len(self.tree))):
            theirs = min(depth, len(docs) - 1)
            if depth:
                if depth < len(self.tree):
                    mine = depth
                    open_ = np.repeat(open_, FAN, axis=0)[: len(self.tree[mine].maxima)]
                if depth < len(docs):
                    nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                    inside = nodes < len(docs[theirs].maxima)
                    nodes, open_ = nodes[inside], np.repeat(open_, FAN, axis=1)[:, inside]
            level = self.tree[mine]
            weakest = np.minimum.reduceat(self.kth, np.arange(0, len(self.kth), level.width))
            few = np.flatnonzero(open_.any(axis=1))
            if depth == max(len(docs), len(self.tree)) - 1:
                self.scored += int(open_.sum())
            bounds = level.maxima[few] @ docs[theirs].maxima[nodes].T
            open_[few] &= bounds >= weakest[few, None]
            left = open_.any(axis=0)
            nodes, open_, bounds = nodes[left], open_[:, left], bounds[:, left]
            if not len(nodes):
                return (np.zeros(0, np.int64),) * 3
        # the last level of both: rows themselves, so the bounds are the scores
        at = np.nonzero(open_[few])
        return few[at[0]], nodes[at[1]], bounds[at].astype(np.int64)

    def _take(self, items: np.ndarray, rows: np.ndarray, scores: np.ndarray, ids: list[int | None]) -> None:
        base = len(self.ids)
        kept, rows = np.unique(rows, return_inverse=True)
        self.ids += [ids[k] for k in kept.tolist()]
        both = np.concatenate([self.best, np.stack([items, scores, rows + base])], axis=1)
        absent = np.array([i is None for i in self.ids])
        number = np.array([0 if i is None else i for i in self.ids], np.int64)
        both = both[:, np.lexsort((number[both[2]], absent[both[2]], -both[1], both[0]))]
        first = np.searchsorted(both[0], np.arange(len(self.kth) + 1))
        both = both[:, np.arange(both.shape[1]) - first[both[0]] < self.top]
        first = np.searchsorted(both[0], np.arange(len(self.kth) + 1))
        full = np.flatnonzero(np.diff(first) == self.top)
        self.kth[full] = both[1, first[full] + self.top - 1]
        used, both[2] = np.unique(both[2], return_inverse=True)
        self.ids = [self.ids[k] for k in used.tolist()]
        self.best = both

    def result(self) -> pa.RecordBatch:
        own = [self.ids[k] for k in self.best[2].tolist()]
        return pa.record_batch({"item": pa.array(self.items[self.best[0]].astype(np.int32)), "doc_id": pa.array(own, pa.int64()), "score": pa.array(self.best[1])})


def _found(held: DataFrame, queries: np.ndarray, weights: np.ndarray, documents: int, terms: int, top: int) -> DataFrame:
    """The best ``top`` documents of each item among those of each task."""
    width = queries.shape[1]
    per_batch = max(1, BLOCK_CELLS // max(width, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(queries, weights, top)
        for batch in batches:
            for lo in range(0, len(batch), per_batch):
                part = batch[lo : lo + per_batch]
                codes, counts = part.column("codes"), part.column("counts")
                size = np.asarray(pc.list_value_length(codes))
                doc = np.repeat(np.arange(len(part)), size)
                norm = length_norm(np.asarray(part.column("n")), documents, terms)
                values = np.zeros((len(part), width), queries.dtype)
                values[doc, np.asarray(codes.flatten())] = term_value(np.asarray(counts.flatten()), norm[doc])
                some = np.flatnonzero(size)
                if len(some):
                    search.add(part.column("doc_id").take(pa.array(some)).to_pylist(), values[some])
        yield search.result()

    return held.mapInArrow(run, FOUND)


def _best(found: DataFrame, by: list[str], top: int) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def _block(docs: DataFrame, block: DataFrame, top: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items (item_id, terms) of one block, which is bounded."""
    spark = docs.sparkSession
    own = block.toArrow().combine_chunks()
    lists = own.column("terms").chunk(0) if own.num_rows else pa.array([], pa.list_(pa.string()))
    flat = lists.flatten().cast(pa.large_binary())
    terms = flat.unique()
    held = written(vectors(docs, terms), "vectors")
    documents, all_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    having = held.select(F.explode("codes").alias("code")).groupBy("code").count().toArrow()
    df = np.zeros(len(terms), np.int64)
    df[having["code"].to_numpy()] = having["count"].to_numpy()
    weights = np.array([term_weight(documents, int(n)) for n in df], np.int64)
    queries = np.zeros((len(lists), len(terms)), np.int64)
    item = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    np.add.at(queries, (item, np.asarray(pc.index_in(flat, value_set=terms))), 1)
    queries *= weights
    if len(lists) and int(queries.sum(axis=1).max()) * 1_000_000 < 1 << 53:
        queries = queries.astype(float)  # every sum is exact in doubles too, and faster
    found = _found(held, queries, weights, documents, all_terms, top)
    first = _best(found.withColumn("group", F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_GROUPS))), ["item", "group"], top)
    ranked = _best(first.select("item", "doc_id", "score"), ["item"], top)
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(lists)), pa.int32()), "item_id": own["item_id"]}))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best documents with a score above 0 of each row of ``items``.

    Equal scores go by ascending doc_id, a null one last. Null and empty texts have no terms: such items have no rows,
    such documents count nowhere. Each repeated row of ``items`` has ranks of its own, each repeated document its place;
    a null item_id is kept. No items, or no documents, give no rows.
    """
    asked = written(item_terms(items).where(F.size("terms") > 0).withColumn("place", F.monotonically_increasing_id()), "items")
    n, words = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n:
        return out
    blocks = math.ceil(math.sqrt(n * words / BLOCK_CELLS))
    for k in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("place"), F.lit(blocks)) == k).select("item_id", "terms")
        if not block.isEmpty():
            out = out.unionByName(_block(docs, block, top))
    return out


ORACLE = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), d AS (SELECT row, doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
a AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
q AS (
  SELECT row, item_id, term, count(*)::BIGINT AS q
  FROM (
    SELECT row_number() OVER () AS row, item_id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
  ) GROUP BY ALL
), f AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, a GROUP BY term),
s AS (
  SELECT q.row AS item_row, item_id, f.row, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN w USING (term), a GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""
