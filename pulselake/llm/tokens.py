"""Tokens of a batch of texts as one Arrow array: runs of chosen bytes, without a Python object per token."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text makes a block of its own.
BLOCK_BYTES = 4 << 20

#: A-Z become a-z, all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*parts: int | range) -> np.ndarray:
    """A mask over the 256 bytes. Bytes from 0x80 on are parts of non-ASCII characters."""
    mask = np.zeros(256, bool)
    for part in parts:
        mask[np.atleast_1d(np.asarray(part))] = True
    return mask


@dataclass
class Tokens:
    """Tokens of texts ``lo`` to ``hi`` of a batch: ``words[i]`` is ``data[start[i]:end[i]]`` and belongs to text ``text[i]``, counted from ``lo``."""

    lo: int
    hi: int
    words: pa.LargeBinaryArray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


#: From the bytes of a block and where its texts begin: the bytes as tokens have them, and at which a token begins anew.
Spelling = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def token_blocks(texts: pa.Array, solid: np.ndarray, block_bytes: int = BLOCK_BYTES, lower: bool = True, spelling: Spelling | None = None) -> Iterator[Tokens]:
    """Maximal runs of ``solid`` bytes, with A-Z lower-cased if ``lower``; a null text counts as empty.

    With ``spelling`` runs are spelt and cut as it says, whatever ``lower`` is.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + block_bytes, "right")) - 1)
        part, begins = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        spelt, cut = spelling(part, begins) if spelling else (LOWER[part] if lower else part, None)
        yield _tokens(lo, hi, spelt, begins, solid, cut)
        lo = hi


def _tokens(lo: int, hi: int, data: np.ndarray, at: np.ndarray, solid: np.ndarray, cut: np.ndarray | None) -> Tokens:
    inside = solid[data]
    begin, finish = inside.copy(), inside.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    if cut is not None:
        edge[:-1] |= cut
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    finish[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    text = np.repeat(np.arange(hi - lo), np.diff(np.searchsorted(start, at)))
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return Tokens(lo, hi, words, text, start, end, data)
