"""Secret scans over a trigram index: Boolean trigram queries derived from the rules choose the texts to verify.

For each rule the parsed pattern is turned into a Boolean query over trigrams that every match must contain
(``trigram_query``). A batch of texts gets an inverted index from the trigrams that any rule asks for to sorted lists of
texts; a rule's query is answered by uniting and intersecting these postings, and the rule's pattern runs over the whole
text of the candidates only. Rules without mandatory trigrams run over every text. The index is a batch's own and is
used at once: an index of the whole corpus would be larger than the corpus and be read once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text
from .text_arrays import blocks


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches (leftmost, not overlapping) whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The base rules, in the order in which kinds are listed, then the rules added to them.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    # a whole run of 16 or more, as "[0-9a-f]+" of that length is, without a match for each letter a to f
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 1),
    Rule("forge", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("url", r"[a-z][a-z0-9+]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 1),
)
RULES = BASE_RULES + MORE_RULES

#: Most strings that an exact set may hold before only its trigrams are kept.
EXACT_LIMIT = 32

# A query is True (any text), a trigram, or ("and" | "or", queries).


def _join(kind: str, parts: list) -> object:
    if kind == "or" and True in parts:
        return True
    parts = sorted({p for p in parts if p is not True}, key=repr)
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _grams(text: str) -> object:
    return _join("and", [text[i : i + 3] for i in range(len(text) - 2)])


def trigram_query(rule: Rule) -> object:
    """The Boolean query over lower-case trigrams that holds for every text with a match of the rule."""
    return _query(list(parser.parse(rule.pattern, re.ASCII)))


def _query(items: list) -> object:
    found: list = []
    exact = {""}  # all strings that the items since the last unbounded one can be

    def close() -> None:
        nonlocal exact
        found.append(_join("or", [_grams(x) for x in exact]))
        exact = {""}

    for code, value in items:
        strings, inner = _exact(code, value)
        if strings is not None and len(strings) * len(exact) <= EXACT_LIMIT:
            exact = {a + b for a in exact for b in strings}
            continue
        close()
        found.append(inner if strings is None else _join("or", [_grams(x) for x in strings]))
    close()
    return _join("and", found)


def _exact(code: object, value: object) -> tuple[set[str] | None, object]:
    """The finite set of strings a parsed item can be, or None and the query that its matches satisfy."""
    if code is op.LITERAL:
        return {chr(value).lower()}, True
    if code is op.IN:
        chars = {chr(v).lower() for c, v in value if c is op.LITERAL}
        return (chars, True) if len(chars) == len(value) <= 8 else (None, True)
    if code is op.SUBPATTERN:
        return _sequence(list(value[3]))
    if code is op.BRANCH:
        each = [_sequence(list(x)) for x in value[1]]
        if all(s is not None for s, _ in each):
            return set().union(*(s for s, _ in each)), True
        return None, _join("or", [q if s is None else _join("or", [_grams(x) for x in s]) for s, q in each])
    if code in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = _sequence(list(inner))
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, True
        if low == 0:
            return None, True
        return None, query if strings is None else _join("or", [_grams(x) for x in strings])
    return None, True


def _sequence(items: list) -> tuple[set[str] | None, object]:
    strings = {""}
    for code, value in items:
        more, _ = _exact(code, value)
        if more is None or len(more) * len(strings) > EXACT_LIMIT:
            return None, _query(items)
        strings = {a + b for a in strings for b in more}
    return strings, True


def _asked(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(_asked(q) for q in query[1]))


_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32


class TrigramIndex:
    """Postings of a batch: for each asked trigram (ASCII letters in lower case) the sorted places of its texts."""

    def __init__(self, texts: pa.Array, grams: list[str]):
        codes = {int.from_bytes(g.encode(), "big"): g for g in grams if len(g.encode()) == 3}
        wanted = np.zeros(1 << 24, bool)
        wanted[list(codes)] = True
        found = [np.zeros((0, 2), np.int64)]
        for b in blocks(texts):
            low = _LOWER[b.data]
            code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
            at = np.flatnonzero(wanted[code])
            text = np.searchsorted(b.at, at, "right") - 1
            inside = at + 3 <= b.at[text + 1]
            found.append(np.unique(np.stack([code[at[inside]], b.lo + text[inside]], axis=1), axis=0))
        pairs = np.concatenate(found)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.size = len(texts)
        self.postings = {g: pairs[np.searchsorted(pairs[:, 0], c) : np.searchsorted(pairs[:, 0], c, "right"), 1] for c, g in codes.items()}

    def candidates(self, query: object) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings.get(query, np.arange(self.size))
        meet = np.intersect1d if query[0] == "and" else np.union1d
        return reduce(meet, sorted((self.candidates(q) for q in query[1]), key=len))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start, end) in code points, end exclusive.

    Spans are ordered by start, then by the order of the rules. Null and empty texts have none; repeated rows have
    equal ones.
    """
    queries = [trigram_query(r) for r in rules]
    grams = sorted(set().union(*(_asked(q) for q in queries)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [r.compiled() for r in rules]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            index = TrigramIndex(batch.column("text"), grams)
            found: list[list] = [[] for _ in texts]
            for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                for place in index.candidates(query):
                    for m in patterns[k].finditer(texts[place]):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[place].append((m.start(), k, m.end()))
            spans = [[{"kind": rules[k].kind, "start": a, "end": z} for a, k, z in sorted(s)] for s in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(spans, kind)})

    return id_and_text(docs).mapInArrow(search, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """The spans of ``scan`` as counts of the base kinds, the digest of the base spans, and the list of all."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = {r.kind for r in BASE_RULES}
        for batch in batches:
            rows = batch.column("spans").to_pylist()
            listed = [[f"{s['kind']}:{s['start']}:{s['end']}" for s in r] for r in rows]
            counts = {f"n_{r.kind}": [sum(s["kind"] == r.kind for s in row) for row in rows] for r in BASE_RULES}
            base_text = [",".join(t for t, s in zip(ts, r, strict=True) if s["kind"] in base) for ts, r in zip(listed, rows, strict=True)]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    **{k: pa.array(v, pa.int64()) for k, v in counts.items()},
                    "base_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in base_text],
                    "spans": pa.array([",".join(t) for t in listed], pa.string()),
                }
            )

    counted = ", ".join(f"n_{r.kind} long" for r in BASE_RULES)
    return found.mapInArrow(fold, f"doc_id long, {counted}, base_sha256 string, spans string")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; touching or overlapping spans by one.

    All rows and columns stay; a null text stays null.
    """
    columns = docs.columns
    queries = [trigram_query(r) for r in rules]
    grams = sorted(set().union(*(_asked(q) for q in queries)))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [r.compiled() for r in rules]
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            index = TrigramIndex(batch.column(at), grams)
            spans: dict[int, list] = {}
            for rule, query, pattern in zip(rules, queries, patterns, strict=True):
                for place in map(int, index.candidates(query)):
                    for m in pattern.finditer(texts[place] or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans.setdefault(place, []).append(m.span())
            for place, own in spans.items():
                texts[place] = _masked(texts[place], own, mask)
            yield pa.record_batch([pa.array(texts, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)], batch.schema)

    return docs.mapInArrow(clean, docs.schema).select(*columns)


def _masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, done, open_to = [], 0, -1
    for start, end in sorted(spans):
        if start > open_to:
            out += [text[done:start] if open_to < 0 else text[open_to:start], mask]
            open_to = end
        open_to = max(open_to, end)
    return "".join(out) + text[max(open_to, 0) :]
