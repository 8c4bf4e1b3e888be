"""Document fingerprints by a homomorphic multiset hash of paragraphs.

Every paragraph is hashed to a wide vector, and a document's state is the sum of its
paragraphs' vectors modulo powers of two, so the order of paragraphs doesn't matter and
one paragraph is put in or taken out by one addition. The vector has two sections: 32
lanes modulo 2^64 from an extendable-output hash of the whole paragraph, which tell
equality (the fingerprint is their hexadecimal form), and 256 lanes modulo 2^32 to
which the paragraph's shingles of three words add their signs, which tell likeness:
the cosine of two such sections estimates that of the two multisets of shingles.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import partitions, slices, table

LANES, SKETCH = 32, 256
_SCALE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Paragraph vectors that a task remembers.
REMEMBERED = 1024
_SMALLEST, _LARGEST = -(1 << 63), (1 << 63) - 1


def paragraphs(text: str) -> list[str]:
    """Lines, empty ones included; none in an empty text."""
    return text.split("\n") if text else []


def _vector(paragraph: str) -> tuple[np.ndarray, np.ndarray]:
    lanes = np.frombuffer(hashlib.shake_128(paragraph.encode("utf-8", "surrogatepass")).digest(8 * LANES), "<u8")
    words = paragraph.split()
    if not words:
        return lanes, np.zeros(SKETCH, np.uint32)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) >= 3:
        h = (h[:-2] * _SCALE + h[1:-1]) * _SCALE + h[2:]
    else:
        h = np.array([sum(int(x) * 31**k for k, x in enumerate(h)) & (1 << 64) - 1], np.uint64)
    h ^= h >> np.uint64(29)
    h *= _MIX
    both = np.bincount((h >> np.uint64(55)).astype(np.int64), minlength=2 * SKETCH).reshape(SKETCH, 2)
    return lanes, (both[:, 0] - both[:, 1]).astype(np.int64).astype(np.uint32)


class State:
    """The running hash of a multiset of paragraphs."""

    def __init__(self, lanes: np.ndarray | None = None, sketch: np.ndarray | None = None) -> None:
        self.lanes = np.zeros(LANES, np.uint64) if lanes is None else lanes
        self.sketch = np.zeros(SKETCH, np.uint32) if sketch is None else sketch

    @classmethod
    def of(cls, text: str, known: dict | None = None) -> State:
        state, known = cls(), {} if known is None else known
        for p in paragraphs(text):
            if (v := known.get(p)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                v = known[p] = _vector(p)
            state.lanes += v[0]
            state.sketch += v[1]
        return state

    def insert(self, paragraph: str) -> State:
        a, b = _vector(paragraph)
        return State(self.lanes + a, self.sketch + b)

    def delete(self, paragraph: str) -> State:
        a, b = _vector(paragraph)
        return State(self.lanes - a, self.sketch - b)

    def __add__(self, other: State) -> State:
        return State(self.lanes + other.lanes, self.sketch + other.sketch)

    def __str__(self) -> str:
        return self.lanes.astype("<u8").tobytes().hex()

    def likeness(self, other: State) -> float:
        """1 for equal multisets, else the estimated cosine of their shingles, from 0 to below 1."""
        if np.array_equal(self.lanes, other.lanes):
            return 1.0
        a, b = self.sketch.view(np.int32).astype(np.float64), other.sketch.view(np.int32).astype(np.float64)
        size = float(a @ a) * float(b @ b)
        return min(max(float(a @ b) / size**0.5, 0.0), 1.0 - 1e-9) if size else 0.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many first code points of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, n_paragraphs)`` for every row, without a shuffle; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for cut in slices(batch):
                found = [t or "" for t in cut.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array([str(State.of(t, known)) for t in found]), pa.array([len(paragraphs(t)) for t in found], pa.int64())], ["doc_id", "fingerprint", "n_paragraphs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string, n_paragraphs long")


def with_following(docs: DataFrame, id_col: str, text_col: str, kernel, schema: str) -> DataFrame:
    """Run ``kernel(id, text, following)`` for every row in descending id order; after the last row comes the first.

    Texts move once: rows are dealt into ranges of ids, and the largest row of each
    range goes to the next range too, as what follows its last row. An id so frequent
    that it would fill several ranges is dealt over them by the hash of its texts. Only
    the ranges' bounds and largest rows' keys, one for each partition, pass the driver.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(_SMALLEST)))
    # Ranges are told by whole numbers. Quantiles, which Spark computes in doubles, are taken from the smallest id on; that they are rounded moves bounds a little.
    base = rows.agg(F.min("doc_id")).first()[0] or 0
    far = F.when(F.col("doc_id").isNull(), -1.0).otherwise((F.col("doc_id").cast("decimal(20,0)") - F.lit(base).cast("decimal(20,0)")).cast("double"))
    cuts = Counter(_SMALLEST if c < 0 else min(base + int(c), _LARGEST) for c in rows.agg(F.percentile_approx(far, [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n))).first()[0] or [])
    # A frequent id has a range of its own, which its share of the cuts divides again.
    lows, shares = [], [1]
    for value, times in sorted(cuts.items()):
        if not lows or lows[-1] < value:
            lows.append(value)
            shares.append(times)
        else:  # the range after the last frequent id begins here
            shares[-1] = times
        if times > 1 and value < _LARGEST:
            lows.append(value + 1)
            shares.append(1)
    steps = [1 << b for b in range(len(lows).bit_length() - 1, -1, -1)] if lows else [1]
    bounds = F.array(*map(F.lit, lows or [_LARGEST])).cast("array<long>")
    bucket = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(bounds, at + step - 1) <= F.col("k"), F.lit(False)), at + step).otherwise(at))
    shares += [1] * (2 - len(shares))
    bucketed = rows.withColumn("bucket", bucket)
    hot = max(shares) > 1
    tie = F.xxhash64("text")
    of = lambda values: F.array(*map(F.lit, values))[F.col("bucket")]
    part = F.floor((tie.cast("double") / 2.0**64 + 0.5) * of(shares)).cast("int") if hot else F.lit(0)
    ranged = bucketed.select("doc_id", "k", "text", (tie if hot else F.lit(0).cast("long")).alias("tie"), (of([0, *accumulate(shares)][:-1]) + F.least(part, of(shares) - 1)).alias("range"))
    tops = sorted((r["range"], *r["top"]) for r in ranged.groupBy("range").agg(F.max(F.struct("k", "tie")).alias("top")).collect())
    sent = [(k, t, tops[(i + 1) % len(tops)][0]) for i, (_, k, t) in enumerate(tops)]
    also = spark.createDataFrame(sent, "k long, tie long, also int")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("guest"))
    both = F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("also").alias("range"), F.lit(True).alias("guest"))))
    dealt = ranged.join(F.broadcast(also), ["k", "tie"], "left").select("doc_id", "k", "text", F.explode(both).alias("to"))
    dealt = dealt.select("doc_id", "k", "text", F.xxhash64("text").alias("tie"), "to.range", "to.guest")
    dealt = dealt.repartitionById(sum(shares), "range").sortWithinPartitions("guest", F.desc("k"), F.desc("tie"))
    return dealt.select("doc_id", "text", "guest").mapInArrow(kernel, schema)


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next)``. Null texts count as empty; null ids come last in the descending order;
    rows with equal ids follow each other by the hash of their text; the only row of a
    table is followed by itself; an empty table gives no rows.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def stream(batches: Iterator[pa.RecordBatch], known: dict) -> Iterator[tuple]:
        """Rows with their states, up to the first guest."""
        for batch in batches:
            for cut in slices(batch):
                for d, t, guest in zip(cut.column("doc_id").to_pylist(), cut.column("text").to_pylist(), cut.column("guest").to_pylist(), strict=True):
                    yield d, t, State.of(t, known)
                    if guest:
                        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        out = []
        for (d, text, state), (_, following, after) in pairwise(stream(batches, known)):
            changed = edited(text, following)
            new = State.of(changed, known)
            out.append((d, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), str(state), str(new), state.likeness(new), state.likeness(after)))
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return with_following(docs, id_col, text_col, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and how near they and the next document's are."""
    return edits(table(spark, sf_dir, "documents"))


