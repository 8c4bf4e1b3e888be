"""Best-fit-decreasing packing of token sequences.

Pieces of equal length are alike, and so are open bins with equal space, so the whole
packing is decided on counts: best fit decreasing visits the lengths from the longest
to the shortest, and a segment tree over the remaining capacities finds the tightest
open bin that still takes a piece. A run of equal pieces going to a run of equal bins
is one step. The table of counts has one row for each length up to the capacity, at
any size of the corpus; the resulting steps say which ranks of a length go to which
bins, and every piece finds its own by its rank in a Spark job.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from kindred.llm.common import map_rows, table
from kindred.llm.tokens import KEPT, ROWS, crc32, encoder, with_end
from kindred.plans.storage import materialise

CAPACITY = 4096
END_ID = 1
#: Pieces of one length are ranked within this many hash buckets, then across them.
RANK_BUCKETS = 1024


class CapacityTree:
    """Segment tree over capacities 0..n that holds how many runs of open bins have each capacity."""

    def __init__(self, n: int) -> None:
        self.size = 1 << (n + 1).bit_length()
        self.held = np.zeros(2 * self.size, np.int64)

    def add(self, capacity: int, change: int) -> None:
        node = self.size + capacity
        while node:
            self.held[node] += change
            node >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity >= ``least`` that an open bin has, found by one climb and one descent."""
        node = self.size + least
        if self.held[node]:
            return least
        while node > 1 and not (node & 1 == 0 and self.held[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.size:
            node = 2 * node if self.held[2 * node] else 2 * node + 1
        return node - self.size


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Steps ``(length, first rank, pieces, first bin, offset)``: piece ``first rank + k`` goes to bin ``first bin + k``.

    The same packing as best fit decreasing piece by piece, among equal pieces and
    equal bins in some order.
    """
    tree, runs = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    steps, bins = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            runs[space].append((first, n))
            tree.add(space, 1)

    for length in sorted((k for k, n in counts.items() if k > 0 and n > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            space = tree.tightest(length)
            if space is None:  # new bins
                space, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[space].popleft()
                tree.add(space, -1)
            # A bin that took one piece is the tightest for the next while it has room, so it is filled first.
            each, base = space // length, capacity - space
            full = min(n, left // each)
            steps += [(length, rank + j * full, full, first, base + j * length) for j in range(each if full else 0)]
            put(space - each * length, first, full)
            rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left:
                steps += [(length, rank + j, 1, first, base + j * length) for j in range(left)]
                put(space - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            if n:
                runs[space].appendleft((first, n))
                tree.add(space, 1)
    return steps


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, by_word: bool = True, kept: int = KEPT) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each text's ids and ``end_id``, cut where longer than ``capacity``."""

    def make():
        own = encoder(tokenizer, by_word, kept)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, bounds = with_end(*own.encode(batch.column("text")), end_id)
            sizes = np.diff(bounds)
            cuts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            at = bounds[doc] + start
            crcs = [crc32(flat[a:b]) for a, b in zip(at, at + length, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *(pa.array(c, t) for c, t in zip((piece, start, length, crcs), kinds, strict=True))], names)

        return kernel

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, piece int, start long, length long, ids_crc32 long", rows=ROWS)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, length`` (1 to ``capacity``).

    Pieces of a length are dealt by all their columns, so those of one id, or of none,
    don't meet in one task. ``cut`` is read twice and must be a written table.
    """
    spark = cut.sparkSession
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64(*cut.columns), F.lit(RANK_BUCKETS)))
    buckets = materialise(bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    # At most one row for each length up to the capacity comes to the driver, however many pieces there are.
    counts = {r["length"]: r["n"] for r in buckets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(best_fit(counts, capacity), np.int64).reshape(-1, 5)
    earlier = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = buckets.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    nth = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    ranked = bucketed.withColumn("nth", nth).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("earlier") + F.col("nth") - 1)
    shared = spark.sparkContext.broadcast(steps)

    def run(batches):
        found = shared.value
        span = int((found[:, 1] + found[:, 2]).max()) if len(found) else 1  # ranks are below it
        keys = found[:, 0] * span + found[:, 1]
        order = np.argsort(keys)
        keys, found = keys[order], found[order]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            step = found[at] if len(found) else found[:0]
            more = [pa.array(step[:, 3] + rank - step[:, 1]), pa.array(step[:, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.select(*cut.columns, "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every document.

    Null texts count as empty (one piece with the end id alone); null and repeated ids
    keep their own rows; an empty table gives no rows. Only documents longer than the
    capacity are cut.
    """
    # The number of the writing task tells equal pieces of repeated rows apart.
    cut = materialise(pieces(docs, **how).withColumn("part", F.spark_partition_id()), "pieces")
    return place(cut, how.get("capacity", CAPACITY)).drop("part")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
