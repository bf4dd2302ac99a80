"""Words of a batch of texts as numpy arrays: spans and 64-bit hashes, without a Python object per word.

A word is a maximal run of bytes other than the six ASCII blanks, i.e. ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 text.
The hash of a byte string is a polynomial over table values (mod 2**64) followed by a bit mixer, so a run of bytes or
of words anywhere in the batch has the same hash as an equal run elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text makes a block of its own.
BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = 0xD6E8FEB86659FD93
_WORD_INVERSE = pow(_WORD_BASE, -1, 1 << 64)

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept for reuse by the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, _U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _power(base, len(values)), out=out[1:])
    return out


@dataclass
class Block:
    """Consecutive texts; word ``i`` is ``data[start[i]:end[i]]`` and belongs to text ``doc[i]``.

    ``first`` has the number of the first word of each text and, last, the number of words. ``lo`` and ``hi`` are the
    texts' places in the batch, ``at`` the byte offsets of the texts in ``data``.
    """

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    _byte_sums: dict
    _word_sums: tuple | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """Hashes of byte spans."""
        sums = self._byte_sums.get(lower)
        if sums is None:
            sums = self._byte_sums[lower] = _prefix((_LOWER if lower else _BYTE)[self.data], _BASE)
        back = _power(_INVERSE, len(self.data) + 1)
        return mix((sums[end] - sums[start]) * back[start] ^ (end - start).astype(_U))

    def word_hash(self, lower: bool = False) -> np.ndarray:
        return self.span_hash(self.start, self.end, lower)

    def run_hash(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs ``start:end`` of words, ``words`` being the hashes of all words of the block."""
        if self._word_sums is None or self._word_sums[0] is not words:
            self._word_sums = (words, _prefix(words, _WORD_BASE))
        sums, back = self._word_sums[1], _power(_WORD_INVERSE, len(words) + 1)
        return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(_U))

    def windows(self, size: int) -> np.ndarray:
        """Starts of all runs of ``size`` words that lie in one text."""
        n = len(self.doc) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """Per text, the number of bytes for which ``mask`` holds."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]


def blocks(texts: pa.Array | pa.ChunkedArray) -> Iterator[Block]:
    """Blocks of about BLOCK_BYTES over an Arrow string column; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES, "right")) - 1)
        yield _block(lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def _block(lo: int, hi: int, data: np.ndarray, at: np.ndarray) -> Block:
    solid = ~BLANK[data]
    begin, finish = solid.copy(), solid.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    finish[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(hi - lo), np.diff(first))
    return Block(lo, hi, data, at, start, end, doc, first, {})
