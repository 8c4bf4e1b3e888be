"""Next documents of ids of any size: exact 64-bit order, frequent ids among neighbours."""

from __future__ import annotations

import hashlib
import random

import pytest

from kindred.llm.fingerprint import edited, edits

TOP = (1 << 63) - 1


def mixed():
    rng = random.Random(2)
    return [(1 << 60) + i for i in range(121)] + [rng.randrange(1 << 60, TOP) for _ in range(879)]


CASES = {
    "consecutive from 2^60": [(1 << 60) + i for i in range(1000)],
    "consecutive up to the largest": [TOP - i for i in range(1000)],
    "consecutive near 7.1e18": [7_100_000_000_000_000_000 + i for i in range(1000)],
    "a cluster and a spread": mixed(),
    "both signs and nulls": [None, *range(-(1 << 63), -(1 << 63) + 300), *range(-150, 150), *range(TOP - 300, TOP + 1)],
    "one row": [5],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("parts", ["8", "32"])
def test_every_edited_text(spark, case, parts):
    ids = CASES[case]
    texts = {d: f"text of {d} " * (1 + i % 3) for i, d in enumerate(ids)}
    order = sorted(ids, key=lambda d: -(1 << 63) - 1 if d is None else d, reverse=True)
    following = {d: order[(i + 1) % len(order)] for i, d in enumerate(order)}
    want = {d: hashlib.sha256(edited(texts[d], texts[following[d]]).encode()).hexdigest() for d in ids}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["doc_id"]: r["edited_sha256"] for r in edits(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("doc_id", "edited_sha256").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want


def test_a_frequent_id_among_neighbours(spark):
    """Half of the rows have one id near 2^60; each other id's row keeps its place."""
    at = (1 << 60) + 7
    rows = [((1 << 60) + i, f"text {i} and more of it") for i in range(200)] + [(at, f"copy {i} of the same id") for i in range(300)]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["edited_sha256"]) for r in edits(got).select("doc_id", "edited_sha256").collect()}
    digest = lambda a, b: hashlib.sha256(edited(a, b).encode()).hexdigest()
    for i in range(200):
        if (1 << 60) + i not in (at, at + 1):
            assert ((1 << 60) + i, digest(rows[i][1], rows[(i - 1) % 200][1])) in got
    assert len(got) == 500 or len({d for d, _ in got}) == 200
