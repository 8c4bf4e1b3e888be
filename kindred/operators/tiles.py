"""Pairs of blocks of rows, without those that no two near rows can fall into.

Exact joins on a distance that no index answers well compare blocks with blocks. Rows
are dealt into blocks of equal size in an order that keeps near rows together. Each
block knows the range of its rows' distances to a few pivots; by the triangle inequality
two rows are at least as far apart as the gap between two such ranges, so pairs of
blocks with a gap over the radius are never made, and no row is copied for them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kindred.plans.order import global_rank, group_rank
from kindred.plans.storage import materialise

BLOCK_ROWS = 4096
#: Blocks whose ranges are looked at on their own, at most; of more, neighbouring ones are looked at together.
MAX_RANGES = 65_536


def in_blocks(rows: DataFrame, *order: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``block``, a number from 0: every so many rows in the given order."""
    ranked = global_rank(rows, "__place", *order, first=0)
    return ranked.withColumn("block", F.floor(F.col("__place") / block_rows).cast("long")).drop("__place")


def in_rings(rows: DataFrame, distances: Column, *order: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``block``, a number from 0: rings of equal size around the nearest of the pivots that ``distances`` are to."""
    near = F.array_position(distances, F.array_min(distances))
    ranked = group_rank(rows.withColumn("__near", near).withColumn("__far", F.array_min(distances)), "__place", ["__near"], F.asc("__far"), *order, first=0)
    ranked = materialise(ranked, "rings")
    cells = {r["__near"]: -(-r["count"] // block_rows) for r in ranked.groupBy("__near").count().collect()}  # a row for each pivot
    first = {c: sum(n for d, n in cells.items() if d < c) for c in cells}
    start = F.coalesce(*[F.when(F.col("__near") == c, n) for c, n in first.items()], F.lit(0))
    return ranked.withColumn("block", (start + F.floor(F.col("__place") / block_rows)).cast("long")).drop("__place", "__near", "__far")


def block_pairs(rows: DataFrame, distances: Column, radius: float | None, reach: Column | None = None) -> tuple[DataFrame, float]:
    """``(i, j)``, i <= j, for blocks that may hold rows within the radius, and the share of all pairs that is left out.

    ``distances`` are each row's to the same pivots. Without a ``radius``, ``reach`` says
    how far each row of the second block may be from one of the first.
    """
    own = rows.select("block", distances.alias("__d"), (F.lit(radius) if reach is None else reach).cast("double").alias("__r"))
    width = F.greatest(F.lit(1), F.ceil((F.max("block") + 1) / MAX_RANGES)).alias("w")
    last = rows.agg(F.max("block").alias("m"), width).first()
    if last["m"] is None:
        return rows.sparkSession.createDataFrame([], "i long, j long"), 0.0
    blocks, wide = last["m"] + 1, int(last["w"])
    pivots = len((own.select("__d").first() or [[]])[0])
    ends = [f(F.col("__d")[p]).alias(f"{name}{p}") for name, f in (("lo", F.min), ("hi", F.max)) for p in range(pivots)]
    stats = own.groupBy(F.floor(F.col("block") / wide).alias("g")).agg(F.max("__r").alias("r"), *ends).orderBy("g").collect()  # MAX_RANGES rows at most
    groups = np.array([s["g"] for s in stats])
    table = (groups, *(np.array([[s[f"{name}{p}"] for p in range(pivots)] for s in stats], float).reshape(len(stats), pivots) for name in ("lo", "hi")), np.array([s["r"] for s in stats], float))
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        groups, lo, hi, radius = shared.value
        for batch in batches:
            for k in batch.column("id").to_pylist():
                gap = np.maximum(lo[k:] - hi[k], lo[k] - hi[k:]).max(axis=1, initial=0.0)
                met = np.flatnonzero(gap <= radius[k:]) + k
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), groups[k])), pa.array(groups[met])], ["a", "b"])

    near = rows.sparkSession.range(len(stats)).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "a long, b long")
    member = lambda g: F.explode(F.sequence(g * wide, F.least((g + 1) * wide, F.lit(blocks)) - 1))
    pairs = materialise(near.withColumn("i", member(F.col("a"))).withColumn("j", member(F.col("b"))).filter("i <= j").select("i", "j"), "tiles")
    return pairs, 1 - pairs.count() / (blocks * (blocks + 1) / 2)


def compare(rows: DataFrame, pairs: DataFrame, kernel: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, tasks: int | None = None) -> DataFrame:
    """``kernel(left, right, same)`` for every pair of blocks that have rows, each on its own; ``same`` for a block with itself.

    ``tasks`` is for kernels whose work is large for few rows, which would be read by few tasks.
    """
    left = rows.join(pairs, rows["block"] == pairs["i"]).drop("block")
    right = rows.select(*[F.col(c).alias(c) for c in rows.columns]).join(pairs.select(F.col("i").alias("i"), F.col("j").alias("j")).filter("i < j"), F.col("block") == F.col("j")).drop("block")

    if tasks is not None:
        left, right = left.repartition(tasks, "i", "j"), right.repartition(tasks, "i", "j")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return kernel(a, b if b.num_rows else a, not b.num_rows)

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(run, schema)


def sample(rows: DataFrame, column: str, n: int) -> list:
    """``n`` different values at most, those with the smallest hashes: a bounded sample that doesn't depend on how rows are dealt."""
    return [r[0] for r in rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(F.xxhash64(column), column).limit(n).collect()]
