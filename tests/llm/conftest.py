from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, fingerprint string, component_id int, size string, labels string, score string, spans string, offset string, keep string, row string, n int, fp string"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, null and repeated ids."""
    rng = random.Random(8)
    long_text = words(rng, 30_000)
    texts = [(1, "one two three four five six", "a"), (2, None, "a"), (3, "", None), (4, long_text, "b"), (4, long_text, "b"), (5, words(rng, 40), None), (5, words(rng, 40), "c"), (None, "nobody's text here", "c"), (7, "one two three four five six", "a"), (8, " \t\n ", "b"), (9, "\n\n", ""), (10, "ünïcode ſtraße 日本 😀 \x00 end", "a")]
    texts += [(100 + i, words(rng, rng.randrange(1, 60)), "abc"[i % 3]) for i in range(40)]
    texts += [(200 + i, texts[20][1], "a") for i in range(10)]
    return texts


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows in a table whose other columns bear the names of results."""
    filled = [(d, t, s, "en", len(t or ""), "f", 1, "s", "l", "x", "y", "o", "k", "r", 5, "p") for d, t, s in odd_rows]
    return spark.createDataFrame(filled, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
