"""Phrase mining, archives and ranked search against plain Python."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pulselake.llm import lexical_search, phrase_mining, warc_archive


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_collocations(rows, least, top):
    """rows: (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, 6):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {p: c for p, c in f.items() if c >= least}
    inside = {(lang, w[i:j]) for (lang, w), c in often.items() for i in range(len(w)) for j in range(i + 1, len(w) + 1) if j - i < len(w) and often[lang, w[i:j]] <= c}
    found = {}
    for (lang, w), a in often.items():
        if len(w) > 1 and (lang, w) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out = set()
    for lang, own in found.items():
        out |= {(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(own)[:top], 1)}
    return out


@pytest.fixture(scope="module")
def tagged(spark, rows):
    rng = random.Random(5)
    given = [(("en", "de", None)[k % 3], t) for k, (_, t) in enumerate(rows)]
    given += [("en", " ".join(rng.choice(("New York", "of the", "é", "the\tmayor of", "a.b", "x")) for _ in range(60))) for _ in range(30)] + [("fr", "one, one, one. one"), ("fr", None)]
    return given, spark.createDataFrame(given, "lang string, text string").selectExpr("*", "1 as n", "2 as id", "3 as total", "4 as score").repartition(3)


@pytest.mark.parametrize("edges", [1 << 20, 50])
def test_collocations(tagged, edges):
    rows, docs = tagged
    got = phrase_mining.collocations(docs, least=5, top=40, trie_edges=edges).collect()
    assert len(got) > 60 and {tuple(r) for r in got} == plain_collocations(rows, 5, 40) and len(got) == len(set(got))


def test_collocations_of_long_texts_and_of_nothing(tagged, monkeypatch):
    rows, docs = tagged
    monkeypatch.setattr(phrase_mining, "BLOCK_BYTES", 300)
    import pyarrow as pa

    texts = [t or "" for _, t in rows]
    parts = phrase_mining._segments(pa.array(texts))
    assert "".join(parts.to_pylist()) == "".join(texts) and len(parts) > len(texts)
    assert phrase_mining.collocations(docs.where("lang = 'xx'")).count() == 0
    assert phrase_mining.collocations(docs, least=10**6).count() == 0


def test_double_array():
    rng = np.random.default_rng(3)
    for heads, symbols, n in ((50, 70_000, 4_000), (3_000, 200, 20_000), (1, 1, 1), (9, 300, 2_500)):
        key = np.unique(rng.integers(0, heads * symbols, n))
        trie = phrase_mining.DoubleArray.build(key // symbols, key % symbols, np.arange(len(key)))
        assert (trie.walk(key // symbols, key % symbols) == np.arange(len(key))).all()
        other = rng.integers(-5, (heads + 2) * symbols, 5_000)
        h, s = other // symbols, other % symbols
        known = dict(zip(key.tolist(), range(len(key)), strict=True))
        assert trie.walk(h, s).tolist() == [known.get(k, -1) if k >= 0 else -1 for k in other.tolist()]
        assert (trie.walk(h, np.full(len(h), -1)) == -1).all()


PAGES = [
    (1, "http://www.B.example:80/x?q=1#f", "<p>one</p>"),
    (2, "http://a.example/", "<p>one</p>"),
    (3, "http://b.example/x?q=1", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1"),
    (4, None, None),
    (5, "http://evil.example/\r\nX: y", ""),
    (6, "", "naïve 日本"),
    (0, "http://a.example/", "<p>one</p>"),
    (0, "http://a.example/", "<p>one</p>"),
    (None, "http://a.example/", "<p>one</p>"),
    (None, None, "alone"),
    (7, "http://a.example/", "alone"),
]


def plain_records(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    for i, _, html in pages:
        raw = (html or "").encode()
        again = i is not None and len(raw) >= least and i > first[html or ""]
        yield i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None


@pytest.mark.parametrize("least", [0, 6])
def test_archives(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as payload", "3 as first").repartition(2)
    got = warc_archive.archived_pages(pages, pages.page_id, least).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(plain_records(PAGES, least))
    order = [(r.url_key.encode(), r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert order == sorted(order) and {"example,b)/x?q=1", "example,a)/", ")"} <= {r.url_key for r in got}
    assert warc_archive.page_records(pages.where("page_id < -1")).collect() == []


def test_usual_payloads_and_many_archives(spark, monkeypatch):
    monkeypatch.setattr(warc_archive, "ARCHIVE_BYTES", 500)
    monkeypatch.setattr(warc_archive, "USUAL", 10)
    rng = random.Random(4)
    pages = [(i, f"http://{rng.choice('abc')}.example/{rng.randrange(9)}", rng.choice(["same", None, f"own {i}", f"some {i % 40}"]) if i % 3 else "same") for i in range(900)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    history = warc_archive.merged_history(warc_archive.read_archives(spark, _written(df)), merge_entries=100)
    got = history.collect()
    assert history.rdd.getNumPartitions() > 3 and len({r.archive for r in got}) > 3
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == Counter(plain_records(pages))
    order = [(r.url_key.encode(), r.captured, r.page_id) for r in got]
    assert order == sorted(order)


def _written(df):
    from uuid import uuid4

    from pulselake.llm.common import removed_at_end, shared_folder

    folder = f"{shared_folder(df.sparkSession)}/archives-{uuid4().hex}"
    removed_at_end(df.sparkSession, folder)
    warc_archive.write_archives(warc_archive.captures(df), folder)
    return folder


def test_records_of_a_damaged_archive(tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    digest = base64.b32encode(hashlib.sha1(b"abc").digest())
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nWARC-Date: 1969-12-31T23:59:59Z\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
    whole = head % (digest, len(block)) + block + b"\r\n\r\n"
    at, length, fields, body = next(warc_archive.records(whole))
    assert warc_archive._entry("a", at, length, fields, body)[3:8] == (5, None, -1, 3, digest.decode())
    with pytest.raises(ValueError):
        list(warc_archive.records(whole[:-9] + whole[-4:]))
    with pytest.raises(ValueError):
        warc_archive._entry("a", at, length, fields, body.replace(b"abc", b"abd"))
    assert gzip.decompress(gzip.compress(whole)) == whole


def test_loser_tree():
    rng = random.Random(6)
    for runs in (1, 2, 3, 5, 8, 13):
        parts = [sorted((rng.randrange(20), rng.randrange(3)) for _ in range(rng.choice((0, 1, 7, 30)))) for _ in range(runs)]
        keys, bounds = [k for p in parts for k in p], [0]
        for p in parts:
            bounds.append(bounds[-1] + len(p))
        got = list(warc_archive.merge_runs(keys, bounds))
        assert [keys[k] for k in got] == sorted(keys) and sorted(got) == list(range(len(keys)))


def plain_search(rows, items, top):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(i, Counter(cut.findall(lower(t)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, size = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    for item, text in items:
        asked, scores = Counter(cut.findall(lower(text))), []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // size
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score:
                scores.append((-score, i is None, i or 0, i))
        yield from ((item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1))


ITEMS = [(1, "again THE of"), (1, "again THE of"), (2, None), (3, "   "), (4, "the the and café changed"), (None, "日本語 one x"), (5, "nowhereatall"), (6, " ".join(["again", "was", "all"] * 40))]


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_ranked_search(spark, docs, rows, monkeypatch, cells):
    monkeypatch.setattr(lexical_search, "BLOCK_CELLS", cells)
    more = [(200 + k, f"item{k % 7} of the {' '.join(t.split()[:5])}") for k, (_, t) in enumerate(rows) if t and t.strip()][:30]
    items = spark.createDataFrame(ITEMS + more, "item_id long, text string").selectExpr("*", "1 as rank", "2 as score", "3 as doc_id")
    got = lexical_search.ranked_search(docs, items).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_search(rows, ITEMS + more, 20))


def test_search_of_nothing(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.ranked_search(nothing, items).count() == 0
    assert lexical_search.ranked_search(docs, items.where("item_id = 2")).count() == 0


def test_whole_batches_are_pruned_and_long_sums_exact():
    rng = np.random.default_rng(8)
    weights = rng.integers(1, 9_000, 60)
    queries = (rng.random((30, 60)) < 0.1) * weights
    values = (rng.random((2_000, 60)) < 0.08) * rng.integers(1, 10**6, (2_000, 60)) * (rng.random((2_000, 1)) < 0.2) + 1
    for kind in (np.int64, float):
        search = lexical_search.Search(queries.astype(kind), weights, 5)
        for lo in range(0, 2_000, 500):
            search.add(list(range(lo, lo + 500)), values[lo : lo + 500].astype(kind))
        scores = queries @ values.T
        want = {(i, d, int(scores[i, d])) for i in range(30) for d in np.lexsort((np.arange(2_000), -scores[i]))[:5] if scores[i, d]}
        assert {(r["item"], r["doc_id"], r["score"]) for r in search.result().to_pylist()} == want
        assert search.scored < search.pairs / 2
