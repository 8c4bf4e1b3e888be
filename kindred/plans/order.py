"""A rank over a whole table, without a task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kindred.plans.storage import materialise


def global_rank(df: DataFrame, name: str, *order: Column, first: int = 1) -> DataFrame:
    """``df`` with ``name``, each row's place from ``first`` in the given order.

    Rows are dealt by range of the order and kept so in a table; places within a range
    follow the number of rows in the ranges before it, of which there are as many as
    shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__range", before.alias("__before")))  # a row for each partition
    place = F.row_number().over(W.partitionBy("__range").orderBy(*order))
    return dealt.join(starts, "__range").withColumn(name, (F.col("__before") + place + (first - 1)).cast("long")).drop("__range", "__before")


def group_rank(df: DataFrame, name: str, group: list[str], *order: Column, first: int = 1) -> DataFrame:
    """``df`` with ``name``, each row's place from ``first`` within its group, in the given order.

    Rows are dealt by range of group and order, so a group of any size is spread over
    tasks; a place is the one within the range plus the group's rows in ranges before
    it, of which a group has no more rows of counts than there are shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(*group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.withColumn("__before", before).filter("__before is not null").select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__range").alias("__r"), "__before")
    same = F.col("__range") == F.col("__r")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    place = F.row_number().over(W.partitionBy("__range", *group).orderBy(*order)) - 1 + first
    joined = dealt.withColumn("__place", place).join(starts, same, "left")
    return joined.withColumn(name, (F.coalesce("__before", F.lit(0)) + F.col("__place")).cast("long")).select(*df.columns, name)
