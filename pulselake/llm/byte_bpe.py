"""Byte-level BPE: corpus-level merge replay for encoding, and decoding.

Texts are cut into pieces by the tokenizer's pattern; the distinct pieces of a batch of texts are its corpus. An
inverted index leads from the rank of a token pair to the places where the pair stands; ranks are applied in order,
each to all its places at once, and a merge touches the index only for the two pairs beside it. As merges never cross
pieces, the batches of a distributed corpus can replay on their own and give the ids of one replay over everything;
a dictionary of all pieces of the corpus would grow with it and have to be joined to every word of every text instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import id_and_text

#: Distinct pieces and distinct stretches between blanks that a worker remembers across batches.
REMEMBERED = 400_000
#: More than any rank.
NONE = 1 << 40
TWO_BLANKS = re.compile(r"\s\s").search


class Vocabulary:
    """Ranks of byte strings, and the merge replay over them."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.single = np.array([self.rank[bytes([x])] for x in range(256)])
        self.pieces = regex.compile(pattern).findall
        pairs = {
            a << 32 | b: r
            for t, r in self.rank.items()
            for k in range(1, len(t))
            if (a := self.rank.get(t[:k])) is not None and (b := self.rank.get(t[k:])) is not None
        }
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_key = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NONE)
        self.known: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that each two tokens make, NONE where there is no such token."""
        key = (a << 32) | b
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def replay(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, merges applied over all words in rank order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(words) else 0
        if not n:
            return [np.zeros(0, np.int64) for _ in words]
        # place n stands for "none": before a word's first token and after its last
        token = np.append(self.single[np.frombuffer(b"".join(words), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[sizes > 0] - 1] = n
        before[(ends - sizes)[sizes > 0]] = n
        after[n] = before[n] = n
        index: dict[int, list[np.ndarray]] = {}
        waiting: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for lo, hi in pairwise(cuts):
                rank = int(ranks[lo])
                if rank in index:
                    index[rank].append(places[lo:hi])
                else:
                    index[rank] = [places[lo:hi]]
                    heapq.heappush(waiting, rank)

        first = np.flatnonzero(after[:n] < n)
        ranks = self._ranks(token[first], token[first + 1])
        if (ranks < NONE).any():
            add(ranks[ranks < NONE], first[ranks < NONE])
        late: list[np.ndarray] = []
        while waiting:
            rank = heapq.heappop(waiting)
            found = index.pop(rank)
            i = np.sort(found[0] if len(found) == 1 else np.concatenate(found))
            if len(i) > 1:
                i = i[np.append(True, i[1:] != i[:-1])]
            j = after[i]
            good = (token[i] >= 0) & (j < n)
            good[good] = self._ranks(token[i[good]], token[j[good]]) == rank
            i, j = i[good], j[good]
            if len(i) > 1 and (j[:-1] == i[1:]).any():
                i = self._apart(i, j)
                j = after[i]
            if not len(i):
                continue
            token[i], token[j] = rank, -1
            k = after[j]
            after[i] = k
            before[k] = i
            before[n] = n
            h = before[i]
            at = np.concatenate([h[h < n], i[k < n]])
            if not len(at):
                continue
            ranks = self._ranks(token[at], token[after[at]])
            if (ranks < NONE).any():
                at, ranks = at[ranks < NONE], ranks[ranks < NONE]
                if ranks.min() < rank:  # a lower rank shows up late: these words are left to their own order
                    late.append(at[ranks < rank])
                add(ranks, at)
        kept = np.flatnonzero(token[:n] >= 0)
        out = np.split(token[kept], np.searchsorted(kept, ends[:-1]))
        for place in np.concatenate(late) if late else ():
            w = int(np.searchsorted(ends, place, "right"))
            out[w] = np.array(self.one_word(words[w]))
        return out

    @staticmethod
    def _apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs that share a token, as in "aaa", every other one from the left."""
        keep, end = [], -1
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if a != end:
                keep.append(a)
                end = b
        return np.array(keep)

    def one_word(self, word: bytes) -> list[int]:
        """Ids of a word by its lowest pair, again and again."""
        ids = [self.rank[bytes([x])] for x in word]
        while True:
            texts = [self.bytes_of[x] for x in ids]
            found = [(r, i) for i, (a, b) in enumerate(pairwise(texts)) if (r := self.rank.get(a + b)) is not None]
            if not found:
                return ids
            r, i = min(found)
            ids[i : i + 2] = [r]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A text is cut at its single blanks, where the pattern cuts it too, each blank going with what follows; a text
        with two blanks in a row is one stretch. Only stretches that the worker does not remember are looked at.
        """
        cut = [[t] if TWO_BLANKS(t) else t.split(" ") for t in texts]
        heads = {own[0] for own in cut if own[0]}
        rest = set().union(*(own[1:] for own in cut))
        wanted = heads | {" " + s for s in rest if s not in self.after_blank}
        pieces = {s: self.pieces(s) for s in wanted}
        missing = list({p for own in pieces.values() for p in own if p not in self.known})
        if len(self.known) + len(missing) > REMEMBERED:
            self.known = {}
            missing = list({p for own in pieces.values() for p in own})
        raw = [p.encode("utf-8") for p in missing]
        whole = [self.rank.get(w) for w in raw]
        merged = iter(self.replay([w for w, r in zip(raw, whole, strict=True) if r is None]))
        for p, r in zip(missing, whole, strict=True):
            self.known[p] = (np.array([r]) if r is not None else next(merged)).astype("<u4").tobytes()
        ids = {s: b"".join([self.known[p] for p in own]) for s, own in pieces.items()}
        head = {s: ids[s] for s in heads} | {"": b""}
        found = {s: ids[" " + s] for s in rest if s not in self.after_blank}
        if len(self.after_blank) + len(found) > REMEMBERED:
            blank, self.after_blank = self.after_blank | found, {}
        else:
            self.after_blank |= found
            blank = self.after_blank
        return [head[own[0]] + b"".join(map(blank.__getitem__, own[1:])) for own in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One per worker process, as its memory of pieces is."""
    return Vocabulary(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int). Null and empty texts have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for part in _parts(batches):
            found = v.encode(part.column("text").to_pylist())
            at = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
            ids = np.frombuffer(b"".join(found), "<i4")
            yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(at, ids)})

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that ids stand for; no ids (or null) give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            column = batch.column("ids")
            raw = [b"" if x is None else v.decode(np.asarray(x)) for x in (s.values if s.is_valid else None for s in column)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "decoded": pa.array(raw, pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encode`` and ``decode`` of each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part in _parts(batches):
            found = v.encode(part.column("text").to_pylist())
            yield pa.record_batch(
                {
                    "doc_id": part.column("doc_id"),
                    "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                    "ids_sha256": [sha(x) for x in found],
                    "decoded_sha256": [sha(v.decode(np.frombuffer(x, "<u4"))) for x in found],
                }
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


#: Bytes of text whose pieces replay together.
PART_BYTES = 12 << 20


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about PART_BYTES of text, or one text."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("text"))).astype(np.int64))
        lo, base = 0, 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, base + PART_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            base, lo = int(sizes[hi - 1]), hi
