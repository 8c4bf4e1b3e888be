"""Lexical search against scores of all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kindred.llm import lexical as X

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    """Every pair of an item and a document, by the formulas."""
    tf = [Counter(plain_terms(t)) for _, t in docs]
    lengths = [sum(c.values()) for c in tf]
    count, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(w for c in tf for w in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for (d, _), c, n in zip(docs, tf, lengths, strict=True):
            if not n:
                continue
            m = 100 - 25 + (25 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m)) for w in plain_terms(text) if w in c)
            if score > 0:
                found.append((-score, d is None, d, score))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, s) for r, (_, _, d, s) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def made(rng, n, vocabulary=300):
    return " ".join(f"W{int(vocabulary * rng.random() ** 3)}{rng.choice(['', ',', '.'])}" for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(9)
    docs = [(i, made(rng, rng.randrange(1, 80))) for i in range(600)]
    docs += [(1000 + i, docs[17][1]) for i in range(60)] + [(5, "w1 w2"), (5, "w1 w2"), (None, docs[3][1]), (None, "w7"), (2000, None), (2001, ""), (2002, "…!?"), (2003, "été W1\x7fW2 ÉTÉ naïve")]
    docs += [(3000 + i, docs[40][1] + f" tail{i}") for i in range(50)]
    items = [(i, made(rng, rng.randrange(1, 25))) for i in range(25)] + [(90, docs[17][1]), (91, docs[40][1]), (92, None), (93, ""), (94, "unknownword"), (95, "w1 w1 w1 été"), (95, "w1 w1 w1 été"), (95, "w2"), (None, "w3 w4")]
    return docs, items


def run(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in X.search(d, spark.createDataFrame(items, "item_id long, text string"), **how).collect()), key=str)


def test_terms():
    for t in ["", None, "A_b-c 9z", "Été ß\x80x", "\x7f[a]`B`{c}", "日本　語 42", "İ I"]:
        assert [w.decode() for w in X.terms(t)] == plain_terms(t)


def test_search_equals_all_pairs(spark, tables):
    assert run(spark, *tables) == plain_search(*tables)


def test_small_portions_and_blocks_lose_nothing(spark, tables, monkeypatch):
    """Many rounds, blocks of few items, one coordinate for many terms, and joins in place of broadcasts."""
    docs, items = tables
    items = items[:6] + items[-9:]
    monkeypatch.setattr(X, "PORTION", 1)
    monkeypatch.setattr(X, "GROWTH", 3)
    monkeypatch.setattr(X, "BLOCK_TERMS", 60)
    monkeypatch.setattr(X, "BROADCAST_KEYS", 0)
    assert run(spark, docs[:400] + docs[600:], items, k=3, width=64) == plain_search(docs[:400] + docs[600:], items, k=3)


def test_bounds_are_never_too_small_and_mostly_exact(tables):
    docs, items = tables
    tf = [Counter(X.terms(t)) for _, t in docs]
    n = np.array([c.total() for c in tf])
    queries = X.Queries.of([{w: 100 + i for i, w in enumerate(Counter(X.terms(t)))} for _, t in items if X.terms(t)], int((n > 0).sum()), int(n.sum()))
    sketches = []
    for c in tf:
        most = {}
        for w, v in c.items():
            at = X.zlib.crc32(w) % X.WIDTH
            most[at] = max(most.get(at, 0), v)
        sketches.append(np.array(sorted(most), "<u2").tobytes() + np.array([most[a] for a in sorted(most)], "<u2").tobytes())
    bounds = queries.bounds(n, sketches)
    exact = np.array([[queries.score(q, c, int(queries.length(c.total()))) for q in range(len(queries.weights))] for c in tf])
    assert (bounds >= exact).all() and ((bounds - exact) <= 1 + exact * 1e-11).mean() > 0.95


def test_best_keeps_ties_and_drops_repeats():
    best = X.Best(2, 2, np.ones(2), np.full(2, np.inf))
    keys = np.array([[0, i] for i in (1, 2, 3, 3, 4)], np.uint64)
    best.add(np.array([[5, 0], [9, 2], [5, 2], [5, 2], [1, 2]], float), keys)
    best.settle()
    q, b, k = best.held
    assert [(int(x), float(y), int(z[1])) for x, y, z in zip(q, b, k, strict=True)] == [(0, 9.0, 2), (0, 5.0, 1), (0, 5.0, 3), (1, 2.0, 2), (1, 2.0, 3), (1, 2.0, 4)]
    assert best.cut.tolist() == [5, 2]


def test_odd_rows(spark, odd, odd_rows, empty):
    items = spark.createDataFrame([(1, "One two w3 w4", 5), (2, None, 5), (3, "ünïcode 日本", 5), (None, "w5 w6 w5", 5)], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in X.search(odd, items).collect()), key=str)
    assert got == plain_search([(d, t) for d, t, _ in odd_rows], [(1, "One two w3 w4"), (2, None), (3, "ünïcode 日本"), (None, "w5 w6 w5")])
    assert X.search(empty, items).count() == 0 and X.search(odd, items.limit(0)).count() == 0
