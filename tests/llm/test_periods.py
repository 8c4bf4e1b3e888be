"""Runs of repeated phrases against the definition."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import periods as P


def plain_runs(words):
    """Every stretch by trying all periods; the smallest period by trying all smaller ones."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(start, end - d)) for d in range(1, q)):
                out.append((start, end - start, q))
    return sorted(out)


def noisy(rng: random.Random, n: int) -> list[bytes]:
    out: list[bytes] = []
    while len(out) < n:
        phrase = [b"%d" % rng.randrange(rng.choice([2, 5, 60])) for _ in range(rng.randrange(1, 30))]
        out += phrase if rng.random() < 0.5 else (phrase * 12)[: rng.randrange(1, len(phrase) * 8 + 2)]
    return out


@pytest.mark.parametrize("size", [1, 2, 8, 16, 64, 512])
def test_zero_sums_are_occurrences(size):
    rng = np.random.default_rng(size)
    words = np.where(rng.random(size * 40) < 0.7, 0, rng.integers(0, 3, size * 40))
    words[: size * 5] = np.tile(rng.integers(0, 9, size), 5)
    got = P.occurrences(words, size)
    want = [[np.array_equal(words[j * size : (j + 1) * size], words[(j + 1) * size + r : (j + 2) * size + r]) for j in range(38)] for r in range(size)]
    assert got.tolist() == want and got.any()


def test_transform_is_a_sum_of_powers():
    x = np.random.default_rng(1).integers(0, P.PRIME, 16).astype(np.uint64)
    w = pow(P.GENERATOR, (P.PRIME - 1) // 16, P.PRIME)
    want = [sum(int(v) * pow(w, i * k, P.PRIME) for i, v in enumerate(x)) % P.PRIME for k in range(16)]
    order = [int(f"{i:04b}"[::-1], 2) for i in range(16)]
    assert P.transform(x[:, None])[:, 0].tolist() == [want[k] for k in order]
    assert (P.inverse(P.transform(x[:, None]))[:, 0] * np.uint64(pow(16, P.PRIME - 2, P.PRIME)) % np.uint64(P.PRIME)).tolist() == x.tolist()


def test_runs_of_many_texts():
    rng = random.Random(3)
    for _ in range(120):
        texts = [noisy(rng, rng.randrange(0, 200)) for _ in range(rng.randrange(1, 8))]
        assert P.runs_of(texts) == [plain_runs(t) for t in texts]


def test_long_periods_and_nested_runs():
    rng = random.Random(4)
    phrase = [b"%d" % rng.randrange(9) for _ in range(1000)]
    inner = [b"x"] * 40 + [b"y"]
    assert P.runs_of([phrase * 4, phrase * 3, inner * 5, [b"z"] * 20_000]) == [[(0, 4000, 1000)], [], sorted([(41 * i, 40, 1) for i in range(5)] + [(0, 205, 41)]), [(0, 20_000, 1)]]


def test_many_interrupted_runs_take_no_pairs():
    words = sum(([b"a"] * 50 + [b"%d" % i] for i in range(400)), [])
    assert P.runs_of([words])[0] == [(51 * i, 50, 1) for i in range(400)]


def test_collapse_keeps_the_first_turn():
    words = b"say no no no no no no more".split()
    assert P.collapse(words, P.runs_of([words])[0]) == b"say no more"


def test_odd_rows(spark, odd, odd_rows, empty):
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in P.repeated_runs(odd).collect()), key=str)
    want = []
    for d, t, _ in odd_rows:
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        found = plain_runs(words) if len(words) < 5000 else P.runs_of([words])[0]
        want.append((d, len(words), found, P.collapse(words, found).decode()))
    assert got == sorted(want, key=str)
    assert P.repeated_runs(empty).count() == 0


def test_planted_texts(spark):
    rng = random.Random(5)
    rows = [(i, " \n".join(str(rng.randrange(50)) for _ in range(i % 90))) for i in range(300)] + [(10_000, None), (None, "a b")]
    for r in P.with_planted(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = dict(rows)[r["doc_id"]]
        words, h = (text or "").split(), zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            assert r["text"] == " ".join(words)
        else:
            assert r["text"] == text


def test_query_is_one_row_per_document(spark, tmp_path):
    rows = [(1, "a b a b a b a b c"), (2, None), (3, ""), (4, "one two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in P.op11_periods(spark, str(tmp_path)).collect()}
    assert [got[1][c] for c in ("n_runs", "start", "length", "period", "exponent_milli")] == [1, 0, 8, 2, 4000]
    assert got[2]["runs_sha256"] == got[2]["collapsed_sha256"] and got[2]["start"] is None and got[2]["n_runs"] == 0
    assert set(P.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("n_words")).toPandas()["n_words"]) == {9, 0, 2}
