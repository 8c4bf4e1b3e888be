"""Runs of repeated phrases in texts, found by block convolution.

A run is a stretch of words that repeats a phrase four times or more. At scale B (a
power of two) the words are cut into blocks of B. The sum of squared differences
between a block and the words q further on, for all q from B to 2B - 1, is a
convolution: one number-theoretic transform for each block gives it, since the
transform of the window that follows is made of those of the next two blocks. A sum of
zero is an occurrence without a mismatch. Every run with a period from B to 2B - 1
holds two neighbouring blocks that both occur again q words on, so such pairs are the
seeds; each is extended word by word in both directions, which also rules out a sum
that is zero only modulo the prime. Stretches inside a run of a smaller period are
left out, and the smallest period of a stretch is checked by its divisors.

Many documents are searched at once, one after another with a mark between them that
equals no word; at each scale only those that are long enough take part.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import map_rows, table

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TURNS = 6, 4
#: A prime 15 * 2^27 + 1 and a generator of its units: transforms of up to 2^27 words.
PRIME, GENERATOR = 2013265921, 31
#: Up to this block length the few terms of the sums are added directly.
DIRECT = 8
#: Numbers that are transformed at once, so that they stay in the processor's cache.
CHUNK = 1 << 14
_P = np.uint64(PRIME)
RUNS = "array<struct<start:long,length:long,period:long>>"


@lru_cache(maxsize=64)
def _roots(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a primitive root of unity of order 2 * half."""
    w = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    w = pow(w, PRIME - 2, PRIME) if inverse else w
    out = np.ones(half, np.uint64)
    n = 1
    while n < half:  # each pass doubles the known powers
        out[n : 2 * n] = out[:n] * np.uint64(pow(w, n, PRIME)) % _P
        n *= 2
    return out


def _less(x: np.ndarray) -> np.ndarray:
    """From below 2 * PRIME to below PRIME: a difference below zero wraps round to a very large number."""
    return np.minimum(x, x - _P)


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainders by PRIME; numpy divides by a constant much faster than it takes remainders."""
    return x - x // _P * _P


def transform(a: np.ndarray) -> np.ndarray:
    """Transform of every column of ``a`` (rows a power of two); results in bit-reversed order."""
    size, m = a.shape
    h = size // 2
    while h:
        parts = a.reshape(size // (2 * h), 2, h, m)
        u, v = parts[:, 0], parts[:, 1]
        out = np.empty_like(parts)
        out[:, 0] = _less(u + v)
        out[:, 1] = _mod((u + (_P - v)) * _roots(h, False)[:, None])
        a = out.reshape(size, m)
        h //= 2
    return a


def inverse(a: np.ndarray) -> np.ndarray:
    """``transform`` undone, but for the factor ``len(a)``."""
    size, m = a.shape
    h = 1
    while h < size:
        parts = a.reshape(size // (2 * h), 2, h, m)
        v = _mod(parts[:, 1] * _roots(h, True)[:, None])
        u = parts[:, 0]
        out = np.empty_like(parts)
        out[:, 0] = _less(u + v)
        out[:, 1] = _less(u + (_P - v))
        a = out.reshape(size, m)
        h *= 2
    return a


@lru_cache(maxsize=64)
def _mirrored(size: int) -> np.ndarray:
    """Where the transform at -k stands, in bit-reversed order: every range from 2^t to 2^(t+1) backwards."""
    out = np.arange(size)
    t = 1
    while t < size:
        out[t : 2 * t] = out[t : 2 * t][::-1]
        t *= 2
    return out


def occurrences(words: np.ndarray, size: int) -> np.ndarray:
    """``(size, n - 2)``: whether each block's words stand again, without a mismatch, size + r words on (modulo the prime).

    ``words``: a number below PRIME for each word, n blocks of ``size`` (a power of two).
    """
    n = len(words) // size
    if size <= DIRECT:
        at = np.arange(n - 2) * size
        return np.stack([np.logical_and.reduce([words[at + i] == words[at + size + r + i] for i in range(size)]) for r in range(size)])
    step = max(1, CHUNK // (2 * size))
    return np.concatenate([_zero_sums(words[a * size : (min(a + step, n - 2) + 2) * size], size) for a in range(0, n - 2, step)], axis=1)


def _zero_sums(words: np.ndarray, size: int) -> np.ndarray:
    x = words.astype(np.uint64)
    blocks = x.reshape(-1, size).T
    spectrum = transform(np.concatenate([blocks, np.zeros_like(blocks)]))
    one, two = spectrum[:, 1:-1], spectrum[:, 2:]
    window = np.concatenate([_less(one[:size] + two[:size]), _less(one[size:] + (_P - two[size:]))])
    crossed = inverse(_mod(spectrum[_mirrored(2 * size), :-2] * window))[:size]
    crossed = _mod(crossed * np.uint64(pow(size, PRIME - 2, PRIME)))  # twice the sum of products, by one factor
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mod(x * x))])
    sums = _mod(squares[size:] - squares[:-size])  # of the squares of any ``size`` words in a row
    own, further = sums[: len(x) - 2 * size : size], sums[size : len(x) - size].reshape(-1, size).T
    return _less(own + further) == crossed


def _reach(words: np.ndarray, at: int, step: int, period: int) -> int:
    """The first place from ``at`` on, in steps of 1 or -1, whose word differs from the one ``period`` later."""
    size = 64
    while True:
        if step > 0:
            later = words[at + period : at + period + size]
            differ = words[at : at + len(later)] != later
        else:
            lo = max(0, at - size + 1)
            differ = (words[lo : at + 1] != words[lo + period : at + 1 + period])[::-1]
        hit = int(differ.argmax())
        if differ[hit]:
            return at + step * hit
        at, size = at + step * size, size * 2


def _primitive(words: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of at least twice ``period`` has no smaller period; by then it would be a divisor."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor:
            factor += 1
            continue
        d = period // factor
        if np.array_equal(words[start : start + period], words[start + d : start + d + period]):
            return False
        while rest % factor == 0:
            rest //= factor
    return True


def find(words: np.ndarray, parts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` of a number for each word, by start and period.

    ``parts`` are the ``(first word, length)`` of what is searched on its own, lengths
    ascending, so that each scale begins where it can matter; a mark, a number that
    occurs once, stands before and after each.
    """
    found: dict[tuple[int, int], int] = {}
    fresh = int(words.max(initial=0)) + 1
    size, first = 1, 0
    while True:
        while first < len(parts) and parts[first][1] < LEAST_TURNS * size:
            first += 1
        if first == len(parts):
            break
        origin = parts[first][0]
        n = -(-(len(words) - origin) // size) + 2
        own = np.arange(fresh, fresh + n * size)  # what follows the last word equals nothing
        own[: len(words) - origin] = words[origin:]
        hits = occurrences(own, size)
        both = hits[:, :-1] & hits[:, 1:]
        r, j = np.nonzero(both)
        if len(r):
            new = np.concatenate([[True], (r[1:] != r[:-1]) | (j[1:] != j[:-1] + 1)])
            last = np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)
            period, begin, end = r[new] + size, origin + j[new] * size, origin + (j[last] + 2) * size + r[new] + size
            covered = np.zeros(len(words) + 1, np.int64)
            for (start, _), stop in found.items():
                covered[start] = max(covered[start], stop)
            covered = np.maximum.accumulate(covered)
            open_ = covered[begin] < end
            for q, b in zip(period[open_].tolist(), begin[open_].tolist(), strict=True):
                stop = _reach(words, b, 1, q)
                if stop < b + size:
                    continue  # zero only modulo the prime
                start = _reach(words, b, -1, q) + 1
                stop += q
                if stop - start >= max(LEAST_WORDS, LEAST_TURNS * q) and (start, q) not in found and _primitive(words, start, q):
                    found[start, q] = stop
        size *= 2
    return sorted((s, e - s, q) for (s, q), e in found.items())


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs ``(start, length, period)`` of every list of words, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= LEAST_WORDS), key=lambda i: len(texts[i]))
    if not order:
        return out
    numbers: dict[bytes, int] = defaultdict(count(len(order) + 2).__next__)
    total = sum(len(texts[i]) + 1 for i in order) + 1
    words, parts, at = np.zeros(total, np.int64), [], 1
    for mark, i in enumerate(order, 1):  # marks 0, 1, 2 and so on, one before every text and one at the end
        n = len(texts[i])
        words[at : at + n] = [numbers[w] for w in texts[i]]
        words[at + n] = mark
        parts.append((at, n))
        at += n + 1
    starts = np.array([a for a, _ in parts])
    for start, length, period in find(words, parts):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[order[k]].append((start - int(starts[k]), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by blanks, without the repeats: of every run the first turn stays."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` for every row, without a shuffle.

    Words are what ASCII white space separates. ``runs`` are all stretches of at least
    six words that repeat a phrase four times or more, ``(start, length, period)`` in
    words from 0; ``collapsed`` is the text without the repeats. Null, empty and blank
    texts have no words and no runs, and collapse to the empty text. Rows with null,
    repeated or equal ids keep their own results; other columns are left out; an empty
    table gives no rows. A text of any length is searched whole, by one task.
    """

    def make():
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = runs_of(words)
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found]
            short = [collapse(w, x).decode() for w, x in zip(words, found, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(runs, kind), pa.array(short, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

        return kernel

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def with_planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` where every tenth text, by the checksum of its id, repeats a phrase of its own to the end; null ids are left alone."""
    h = F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(1))
    g, words, n = F.floor(F.col("h") / 10), F.col("words"), F.size("words").cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    rows = rows.withColumn("a", F.when(n > 0, F.pmod(g, n)).otherwise(0).cast("int")).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    turns = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    rest = F.slice(F.flatten(F.array_repeat(F.slice(words, F.col("a") + 1, F.col("p")), turns)), F.lit(1), (n - F.col("a")).cast("int"))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), F.col("a")), rest), " ")
    return rows.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periods(spark, sf_dir: str) -> DataFrame:
    """The runs of every document, every tenth with a planted one; of no run the longest's four columns are null."""
    docs = table(spark, sf_dir, "documents")
    found = repeated_runs(with_planted(docs))
    runs = F.col("runs")
    longest = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    rows = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), longest.alias("__m"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = F.col("__m.start"), -F.col("__m.length"), F.col("__m.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
