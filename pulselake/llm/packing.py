"""Best-fit packing of tokenised documents into sequences, with lower bounds that certify it.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to partitions of bounded size, and each is
packed by best-fit decreasing. Dual feasible functions give each partition, and the whole by its 4096 possible lengths,
a number of sequences that no packing can go below. While the total is above the bound of the whole, partitions with
gaps exchange what lies in their unfilled sequences: those pieces are dealt anew and packed again, until the bound is
reached or several dealings in a row save nothing. Partitions that meet their own bound keep out of it while others do not.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, written
from .tokens import LOWER, byte_class, token_blocks

CAPACITY = 4096
#: Pieces that are packed together, on average.
PARTITION_PIECES = 8_192
#: Exchanges without a sequence saved, each with another dealing, after which there are no more.
FRUITLESS = 4
END_OF_DOCUMENT = 1
#: Words whose ids a worker remembers.
REMEMBERED = 800_000
#: Words that the tokenizer gets at once, a blank between them.
TOGETHER = 1_024
#: Letters whose lower case depends on their place or has more than one letter.
ODD_LOWER = frozenset("\u03a3\u0130")

#: The tokenizer parts texts at white space; of that, all that is ASCII.
SOLID = ~byte_class(0x20, range(0x09, 0x0E))
ODD, LETTER, DIGIT, MARK = range(4)
APOSTROPHE = 0x27

#: How byte-level tokenizers write a byte as a letter: printable ones as themselves, the others from U+0100 on. Blanks part words.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = np.arange(256, dtype="<u2")
BYTE_LETTERS[np.setdiff1d(np.arange(256), PRINTABLE)] = np.arange(256, 512 - len(PRINTABLE))
BYTE_LETTERS[0x20] = 0x20

PIECE_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray, frozenset[str]]:
    """The kind of each byte, and which characters of the basic plane, and bytes, are letters; and letters to leave to the tokenizer.

    Those are the ones that lower case and composing turn into something else than letters.
    """
    some = map(chr, [*range(0x80, 0x3000), *range(0xF900, 0xFB50)])
    odd = ODD_LOWER.union(c for c in some if c.isalpha() and not unicodedata.normalize("NFC", c.lower()).isalpha())
    letters = np.array([chr(c).isalpha() and chr(c) not in odd for c in range(0x10000)])
    kinds = np.full(256, ODD, np.uint8)
    kinds[:0x80] = MARK
    kinds[:0x80][letters[:0x80]] = LETTER
    kinds[0x30:0x3A] = DIGIT
    return kinds, letters, odd


def _kind(data: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8 text: of a letter, of an ASCII digit, of another ASCII mark, of anything else."""
    kinds, letters, _ = _kinds()
    kind = kinds[data]
    lead = np.flatnonzero(data >= 0xC0)
    first = data[lead]
    for longer, (low, high) in ((1, (0xC0, 0xE0)), (2, (0xE0, 0xF0))):
        at = lead[(first >= low) & (first < high)]
        code = data[at].astype(np.int64) & (high - low - 1)
        for k in range(1, longer + 1):
            code = code << 6 | data[at + k] & 0x3F
        at = at[letters[code]]
        for k in range(longer + 1):
            kind[at + k] = LETTER
    return kind


class _Words:
    """The tokenizer of a worker process with the ids of words that it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, "<u4"), np.zeros(1, np.int64)  # word k has ids[at[k]:at[k + 1]]

    def spelling(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokenizer parts a text whatever stands around: between letters, digits and other marks of ASCII.

        An apostrophe may belong to the letters after it, and what is not ASCII to its neighbours. Special tokens are
        parted from all else. A-Z are lower-cased, but before what may be composed with them, as that comes first.
        """
        kind = _kind(data)
        cut = np.zeros(len(data), bool)
        before, after = kind[:-1], kind[1:]
        cut[1:] = (before != after) & (before != ODD) & (after != ODD) & ((after != LETTER) | (data[:-1] != APOSTROPHE))
        raw = data.tobytes()
        for special in self.special:
            lo = raw.find(special)
            while lo >= 0:
                hi = lo + len(special)
                if np.searchsorted(texts, lo, "right") == np.searchsorted(texts, hi - 1, "right"):  # in one text
                    cut[lo + 1 : hi] = False
                    cut[[lo, *([hi] if hi < len(cut) else [])]] = True
                lo = raw.find(special, hi)
        spelt = LOWER[data]
        kept = np.flatnonzero(after == ODD)
        spelt[kept] = data[kept]
        return spelt, cut

    def _learn(self, words: list[str]) -> None:
        odd = _kinds()[2]
        simple = [w.isalpha() and (w.isascii() or odd.isdisjoint(w)) for w in words]
        plain, rest = list(compress(words, simple)), [w for w, s in zip(words, simple, strict=True) if not s]
        ids, sizes = [self.ids], []
        # letters alone: neither the pattern nor, but for composing, the normalizer has anything to do
        for lo in range(0, len(plain), TOGETHER):
            text = " ".join(plain[lo : lo + TOGETHER]).lower()
            if not text.isascii():
                raw = unicodedata.normalize("NFC", text).encode()
                text = BYTE_LETTERS[np.frombuffer(raw, np.uint8)].tobytes().decode("utf-16-le")
            ids.append(np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
            sizes.append(np.diff(np.flatnonzero(self.ends[ids[-1]]), prepend=-1))
        # of the others a token belongs to the word in which it begins
        for lo in range(0, len(rest), TOGETHER):
            part = rest[lo : lo + TOGETHER]
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            ids.append(np.array(encoded.ids, "<u4"))
            sizes.append(np.diff(np.searchsorted(np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 0], starts)))
        self.numbers.update(zip(plain + rest, range(len(self.numbers), len(self.numbers) + len(words)), strict=True))
        self.ids = np.concatenate(ids)
        self.at = np.append(self.at, self.at[-1] + np.cumsum(np.concatenate(sizes)))

    def _known(self, words: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.numbers.get, words, repeat(-1)), np.int64, len(words))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For blocks of texts: their ids one after another, END_OF_DOCUMENT after each text, and where each text begins.

        The tokenizer drops white space and never joins what it parts, so each word has its ids whatever stands beside it.
        """
        for t in token_blocks(texts, SOLID, spelling=self.spelling):
            coded = t.words.dictionary_encode()
            distinct = coded.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False)
            number = self._known(distinct)
            new = np.flatnonzero(number < 0)
            if len(new) and len(self.numbers) + len(new) > REMEMBERED:
                self._forget()
                new = np.arange(len(distinct))
            if len(new):
                self._learn(distinct[new].tolist())
                number[new] = self._known(distinct[new])
            which = number[coded.indices.to_numpy()]
            size = self.at[which + 1] - self.at[which]
            count = np.bincount(t.text, size, t.hi - t.lo).astype(np.int64) + 1
            begin = np.append(0, np.cumsum(count))
            ids = np.full(begin[-1], END_OF_DOCUMENT, "<u4")
            inside = np.ones(len(ids), bool)
            inside[begin[1:] - 1] = False
            ids[inside] = self.ids[np.repeat(self.at[which] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))]
            yield ids, begin


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row of ``docs``; a null or empty text is one piece, the end token alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for ids, begin in _words(tokenizer_path).encode(batch.column("text")):
                length = np.diff(begin)
                many = -(-length // capacity)
                text = np.repeat(np.arange(len(length)), many)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
                start = begin[text] + piece * capacity
                end = np.minimum(start + capacity, begin[text + 1])
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                columns = (piece.astype(np.int32), piece * capacity, end - start, np.array(crc, np.int64))
                yield pa.record_batch([batch.column("doc_id")[lo : lo + len(length)].take(pa.array(text)), *map(pa.array, columns)], [c.split()[0] for c in PIECE_COLUMNS.split(", ")])
                lo += len(length)

    return id_and_text(docs).mapInArrow(cut, PIECE_COLUMNS)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. Longest first, each into the bin with the smallest gap that takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: there is a bin with gap g
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            to = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, to, count = capacity, count, count + 1
        bins[i], offsets[i] = to, capacity - gap
        by_gap[gap - size].append(to)
        gaps |= 1 << (gap - size)
    return bins, offsets


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that ``counts`` pieces of each of ``lengths`` can fill, by two families of dual feasible functions.

    For a threshold e, lengths over capacity - e count as a whole bin and those under e as nothing; for a number k,
    a length x counts as floor((k + 1) x / capacity) k-ths of a bin, or as x where the division is exact.
    """
    if not counts.sum():
        return 0
    order = np.argsort(lengths)
    x, n = np.asarray(lengths)[order].astype(np.int64), np.asarray(counts)[order].astype(np.int64)
    many, mass = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * x))
    best = -(-int(mass[-1]) // capacity)
    for e in np.unique(np.minimum(x, capacity - x))[:]:
        if 0 < e <= capacity // 2:
            lo, hi = np.searchsorted(x, e), np.searchsorted(x, capacity - e, "right")
            best = max(best, int(many[-1] - many[hi]) + -(-int(mass[hi] - mass[lo]) // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * x
        share = np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)  # in k-ths of a token
        best = max(best, -(-int((share * n).sum()) // (k * capacity)))
    return best


def _pack(rows: DataFrame, partitions: int, salt: int, capacity: int) -> DataFrame:
    def run(key: tuple[pa.Scalar], group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(length, capacity)
        size, number = np.unique(length, return_counts=True)
        filled = np.bincount(bins, length).astype(np.int64)
        certified = np.full(len(length), len(filled) == lower_bound(size, number, capacity))
        sequence = (salt << 56) + (key[0].as_py() << 24) + bins
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("filled", filled[bins]), ("certified", certified)):
            group = group.append_column(name, pa.array(values))
        return group

    place = F.pmod(F.xxhash64("doc_id", "piece", F.lit(salt)), F.lit(partitions)).alias("place")
    schema = f"{PIECE_COLUMNS}, place long, sequence_id long, offset long, filled long, certified boolean"
    return rows.select(*(c.split()[0] for c in PIECE_COLUMNS.split(", ")), place).groupBy("place").applyInArrow(run, schema)


def _sequences(packed: DataFrame) -> int:
    """A sequence has exactly one piece at offset 0."""
    return packed.where("offset = 0").count()


def bound(packed: DataFrame, capacity: int = CAPACITY) -> int:
    """The lower bound for all pieces, from the number of each length (at most ``capacity`` rows)."""
    sizes = packed.groupBy("length").count().toArrow()
    return lower_bound(sizes["length"].to_numpy(), sizes["count"].to_numpy(), capacity)


def pack(items: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """``items`` (PIECE_COLUMNS) with sequence_id and offset: gapless, at most ``capacity`` tokens in a sequence.

    Equal and repeated pieces are packed each on its own; no items give no rows.
    """
    items = written(items, "pieces")
    partitions = max(1, math.ceil(items.count() / partition_pieces))
    packed = written(_pack(items, partitions, 0, capacity), "packed")
    least, now = bound(items, capacity), _sequences(packed)
    salt = fruitless = 0
    while now > least and partitions > 1 and fruitless < FRUITLESS:
        salt += 1
        # filled sequences stay, and those of certified partitions as long as exchanges among the others save some
        open_ = F.col("filled") < capacity
        if not fruitless and packed.where(open_ & ~F.col("certified")).select("place").distinct().count() > 1:
            open_ &= ~F.col("certified")
        settled, gaps = packed.where(~open_), packed.where(open_)
        partitions = max(1, math.ceil(gaps.count() / partition_pieces))
        again = written(settled.unionByName(_pack(gaps, partitions, salt, capacity)), "packed")
        then = _sequences(again)
        fruitless = fruitless + 1 if then >= now else 0
        if then < now:
            packed, again, now = again, packed, then
        discard(again)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer_path, capacity), capacity)
