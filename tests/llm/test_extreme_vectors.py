"""Vectors of any size: cosines don't depend on it, and nothing overflows or vanishes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kindred.llm.neighbours import scaled, search


def test_scaling_is_exact():
    x = np.random.default_rng(1).normal(size=(50, 8)) * np.logspace(-300, 300, 50)[:, None]
    s = scaled(x)
    assert np.all((np.abs(s).max(axis=1) >= 0.5) & (np.abs(s).max(axis=1) < 1))
    exponent = np.frexp(np.abs(x).max(axis=1))[1]
    assert np.array_equal(np.ldexp(s, exponent[:, None]), x)


def test_extreme_vectors_rank_like_ordinary_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    size = np.ldexp(1.0, rng.choice([-1000, -700, -3, 0, 5, 700, 1000], 300))
    rows = [(i, v.tolist()) for i, v in enumerate(x * size[:, None])]
    rows += [(1000, [1e-320] * 8), (1001, [1e200] + [0.0] * 7), (1002, [0.0] * 8), (1003, [float("inf")] * 8), (1004, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = search(table, F.col("vec_id") % 50 == 0, 5, share=1.0).collect()
    every = np.concatenate([x, np.ones((1, 8)), np.eye(8)[:1]])
    ids = [*range(300), 1000, 1001]
    unit = every / np.linalg.norm(every, axis=1)[:, None]
    cosine = unit @ unit.T
    for q in (i for i in ids if i % 50 == 0):
        at = ids.index(q)
        want = sorted((i for i in range(len(ids)) if i != at), key=lambda i: (-cosine[at, i], ids[i]))[:5]
        got = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in got] == [ids[i] for i in want]
        assert np.allclose([r["score"] for r in got], [cosine[at, i] for i in want], rtol=1e-12)
    assert {r["query_id"] for r in found} == {0, 50, 100, 150, 200, 250, 1000}
