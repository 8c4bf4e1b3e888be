"""Joins that keep the rows of a hot key where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.plans.storage import materialise

#: A key with more than this share of all rows is hot; there are fewer such keys than this, at any size.
SHARES = 4096


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and in ``n`` the number of its rows.

    ``total`` is the number of rows in all. Hot keys are looked up in a broadcast table,
    whose size the shares bound, so no task gathers their rows; all others are joined.
    Rows whose key is null or not in ``table`` drop out.
    """
    hot = F.broadcast(table.filter(F.col(n) > total // SHARES).drop(n))
    plain = rows.join(hot.select(*on), on, "left_anti").join(table.filter(F.col(n) <= total // SHARES).drop(n), on)
    return rows.join(hot, on).unionByName(plain)


#: Rows of one key on one side that meet the other side's in one task.
TILE_ROWS = 8192
#: Keys that may be broadcast with the number of their slices; of more the table is joined by a shuffle.
BROADCAST_KEYS = 500_000


def _hot(right: DataFrame, on: list[str], tile_rows: int) -> DataFrame | None:
    """The keys with more than ``tile_rows`` rows and the number of their slices; none if there are none."""
    hot = materialise(right.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > tile_rows).select(*on, F.ceil(F.col("n") / tile_rows).cast("int").alias("__k")), "hot")
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= BROADCAST_KEYS else hot


def _dealt(side: DataFrame, hot: DataFrame, on: list[str], own: str, other: str, seed: int) -> DataFrame:
    """A side's rows with their own slice, once for every slice of the other side."""
    rest = [F.col(c) for c in side.columns if c not in on]
    sized = side.join(hot, on, "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
    sized = sized.withColumn(own, F.pmod(F.xxhash64(*rest, F.lit(seed)), F.col("__k")).cast("int"))
    return sized.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__k") - 1))).drop("__k")


def deal_tiled(left: DataFrame, right: DataFrame, on: list[str], tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with slices ``__l, __r``: rows with equal ``on`` meet in one pair of slices, which has about ``tile_rows`` rows of the right side at most."""
    hot = _hot(right, on, tile_rows)
    if hot is None:
        return tuple(side.withColumns({"__l": F.lit(0), "__r": F.lit(0)}) for side in (left, right))
    return _dealt(left, hot, on, "__l", "__r", 1), _dealt(right, hot, on, "__r", "__l", 2)


def join_tiled(left: DataFrame, right: DataFrame, on: list[str], tile_rows: int = TILE_ROWS) -> DataFrame:
    """``left`` joined with ``right`` where the columns ``on`` (never null) are equal, hot keys in square tiles.

    A key with more than ``tile_rows`` rows on the right is dealt into slices on both
    sides; each pair of slices is a key of its own, so no task gets all pairs of a key.
    """
    hot = _hot(right, on, tile_rows)
    if hot is None:
        return left.join(right, on)
    return _dealt(left, hot, on, "__l", "__r", 1).join(_dealt(right, hot, on, "__r", "__l", 2), [*on, "__l", "__r"]).drop("__l", "__r")
