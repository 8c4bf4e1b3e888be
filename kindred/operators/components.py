"""Connected components of an edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.plans.joins import join_counted
from kindred.plans.storage import discard, materialise


def _with_least(rows: DataFrame, keyed: DataFrame, total: int) -> DataFrame:
    """``rows`` (``src, dst``) with ``m``, the smallest ``dst`` that ``keyed`` has for their ``src``."""
    return join_counted(rows, keyed.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n")), ["src"], total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Link every larger neighbour of u to the smallest member of u's neighbourhood."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = _with_least(both.filter("dst > src"), both, total)
    return found.select(F.col("dst").alias("src"), F.least("src", "m").alias("dst"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges point from larger to smaller: link all smaller neighbours of u, and u, to the smallest."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    linked = _with_least(down, down, total)
    own = linked.select(F.col("src"), F.col("m").alias("dst"))
    return linked.filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(own)


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, and those that are pointed to, to none."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.filter("out > 1 or out > 0 and into > 0").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest node reachable.

    Each round is two aggregations and two joins whose output is written to the shared
    folder; nothing is gathered on the driver. A hub never meets in one task: its minimum
    is pre-aggregated, and its rows look that up in a broadcast table of bounded size
    (``join_counted``). Rows with a null end are ignored; self-loops give a component of their own;
    an empty input gives an empty result.
    """
    clean = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null")
    clean = materialise(clean.distinct(), "edges")
    loops = clean.filter("src = dst").select(F.col("src").alias("node"))
    current, n = clean.filter("src <> dst"), clean.count()
    for _ in range(max_rounds):
        star = materialise(_large_star(current, n).filter("src <> dst").distinct(), "stars")
        now = materialise(_small_star(star, n).filter("src <> dst").distinct(), "stars")
        discard(star, current)
        current, n = now, now.count()
        if _settled(current):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("dst").alias("node")).unionByName(loops).distinct()
    members = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    alone = roots.join(members.select("node"), "node", "left_anti")
    return members.unionByName(alone.select("node", F.col("node").alias("component")))
