"""From rows and edges to groups: exact copies, components, group statistics, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions.scalars import hamming
from kindred.operators.components import connected_components
from kindred.operators.similarity import scope_key
from kindred.plans.options import ScanOptions
from kindred.plans.joins import join_counted
from kindred.plans.order import global_rank
from kindred.plans.storage import materialise

#: Order of the methods in numbering and reports.
METHOD_ORDER = ("exact", "perceptual", "feature", "video", "semantic")
BITS = 64
#: Numbers of a vector that are added up in one row.
PIECE = 64
#: The columns of ``all_groups``.
GROUPS = "method string, first_ord long, n_files long, similarity double, multi_account boolean, group_id long"


def assign_scope(files: DataFrame, cross_doc: bool = False, source_group: str = "source_group") -> DataFrame:
    """Rows of one document are compared among themselves, all others in one pool (null scope)."""
    return files.withColumn("scope", F.lit(None).cast("string") if cross_doc else F.col(source_group))


def comparable(files: DataFrame, least: int = 2) -> DataFrame:
    """Without scopes of fewer than ``least`` files (the pool always stays)."""
    large = files.filter("scope is not null").groupBy("scope").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select("scope")
    return files.filter("scope is not null").join(large, "scope", "left_semi").unionByName(files.filter("scope is null")).select(files.columns)


def exact_members(files: DataFrame, scope: str = "scope", key: str = "md5", order: str = "ord") -> DataFrame:
    """``(scope, md5, ord, first_ord, n_files)`` for rows whose digest occurs twice or more in their scope.

    Sizes come from a pre-aggregated count joined back, so copies of one file never
    gather in one task. Null digests form no group.
    """
    sizes = files.filter(F.col(key).isNotNull()).groupBy(scope, key).agg(F.count("*").alias("n_files"), F.min(order).alias("first_ord")).filter("n_files >= 2")
    s = sizes.select(F.col(scope).alias("__s"), F.col(key).alias("__k"), "n_files", "first_ord")
    joined = files.join(s, (F.col(key) == F.col("__k")) & F.col(scope).eqNullSafe(F.col("__s")))
    return joined.select(F.col(scope).alias("scope"), F.col(key).alias("md5"), F.col(order).alias("ord"), "first_ord", "n_files")


def exact_groups(files: DataFrame, scope: str = "scope", key: str = "md5", order: str = "ord") -> DataFrame:
    """``(scope, md5, n_files, first_ord, similarity)``: one row for each digest with copies; similarity 1."""
    out = files.filter(F.col(key).isNotNull()).groupBy(F.col(scope).alias("scope"), F.col(key).alias("md5")).agg(F.count("*").alias("n_files"), F.min(order).alias("first_ord"))
    return out.filter("n_files >= 2").withColumn("similarity", F.lit(1.0))


def number_groups(groups: DataFrame, *order: Column) -> DataFrame:
    """Dense ``group_id`` from 1 over the table of groups, in the given order."""
    return global_rank(groups, "group_id", *order)


def method_rank(method: Column) -> Column:
    out = F.lit(len(METHOD_ORDER))
    for i, m in enumerate(METHOD_ORDER):
        out = F.when(method == m, i).otherwise(out)
    return out


def components_of(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(ord, first_ord)``: every node of an edge list with the smallest node of its component."""
    return connected_components(edges, a, b).select(F.col("node").alias("ord"), F.col("component").alias("first_ord"))


def perceptual_members(hashes: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(ord, first_ord)`` for the files under any hash that has edges; all files of such a hash are in one component."""
    found = connected_components(edges, "a", "b").select(F.col("node").alias("first"), F.col("component").alias("first_ord"))
    of_hash = materialise(nodes.select("s", "h", "n", "first").join(found, "first").drop("first"), "components")
    rows = hashes.select(scope_key(F.col("scope")).alias("s"), "h", "ord")
    return join_counted(rows, of_hash, ["s", "h"], rows.count()).select("ord", "first_ord")


def _pair_bits(column: str) -> Column:
    """Differing bits summed over all pairs of a group: each bit gives ones times zeros."""
    n = F.count(column)
    total = F.lit(0).cast("long")
    for bit in range(BITS):
        ones = F.sum(F.shiftrightunsigned(F.col(column), bit).bitwiseAND(1))
        total = total + ones * (n - ones)
    return total


def perceptual_groups(hashes: DataFrame, edges: DataFrame, members: DataFrame, options: ScanOptions = ScanOptions(), missing_pair: str = "zero") -> DataFrame:
    """``(first_ord, n_files, avg_full, avg_top, similarity, multi_account)`` for each component.

    ``hashes``: ``ord, h, tp`` (full and top hash, longs; an absent top hash counts as
    the full one). ``edges``: ``a, b, dist, dist_top``, or such rows added up with their
    number in ``n`` (``edge_sums``). Full and top averages run over all pairs, by counts
    of bits, without making pairs. The blended average sums over edges; with ``missing_pair="zero"`` a
    pair without an edge counts as 0 (the denominator is all pairs), with ``"observed"``
    only edges count.
    """
    own = hashes.withColumn("tp", F.coalesce("tp", "h")).join(members, "ord")
    pairs = F.col("n_files") * (F.col("n_files") - 1) / 2
    stats = own.groupBy("first_ord").agg(F.count("*").alias("n_files"), _pair_bits("h").alias("full_bits"), _pair_bits("tp").alias("top_bits"))
    blended = options.blend_full * F.col("dist") + options.blend_top * F.col("dist_top")
    linked = edges.join(members, edges["a"] == members["ord"]).groupBy("first_ord").agg(F.sum(blended).alias("blended"), (F.sum("n") if "n" in edges.columns else F.count("*")).alias("n_edges"))
    joined = stats.join(linked, "first_ord").withColumn("avg_full", F.col("full_bits") / pairs).withColumn("avg_top", F.col("top_bits") / pairs)
    average = F.col("blended") / (pairs if missing_pair == "zero" else F.col("n_edges"))
    multi = (F.col("avg_top") >= options.multi_account_min_top) & (F.col("avg_top") > F.col("avg_full") * options.multi_account_ratio)
    return joined.select("first_ord", "n_files", "avg_full", "avg_top", F.round(F.greatest(F.lit(0.0), 1 - average / BITS), 3).alias("similarity"), multi.alias("multi_account"))


def feature_groups(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``(first_ord, n_files, similarity)``: the mean score of the component's scored edges.

    ``edges``: ``a, score``, or such rows added up with their number in ``n`` (``feature_links``).
    """
    mean = F.sum("score") / F.sum("n") if "n" in edges.columns else F.avg("score")
    scores = edges.join(members, edges["a"] == members["ord"]).groupBy("first_ord").agg(F.round(mean, 3).alias("similarity"))
    return members.groupBy("first_ord").agg(F.count("*").alias("n_files")).join(scores, "first_ord")


def semantic_groups(vectors: DataFrame, members: DataFrame) -> DataFrame:
    """``(first_ord, n_files, similarity)``: the mean cosine of all pairs, from sums of unit vectors.

    ``vectors``: ``ord, unit``. With s the sum of n unit vectors the mean over pairs is
    (s.s - sum of squared lengths) / (n (n - 1)), so no pair is made.
    """
    last = F.greatest(F.floor((F.size("unit") - 1) / PIECE), F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("unit", k * PIECE + 1, PIECE))
    own = vectors.join(members, "ord").select("first_ord", F.posexplode(pieces).alias("piece", "x"))
    squares = F.sum(F.aggregate("x", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0)))).alias("q")
    sums = own.groupBy("first_ord", "piece").agg(squares, *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(PIECE)])
    dots = sum((F.coalesce(F.col(f"s{i}") * F.col(f"s{i}"), F.lit(0.0)) for i in range(PIECE)), F.lit(0.0)) - F.col("q")
    total = sums.groupBy("first_ord").agg(F.sum(dots).alias("dots"))
    sizes = members.groupBy("first_ord").agg(F.count("*").alias("n_files"))
    return sizes.join(total, "first_ord").select("first_ord", "n_files", (F.col("dots") / (F.col("n_files") * (F.col("n_files") - 1))).alias("similarity"))


def video_groups(members: DataFrame) -> DataFrame:
    """``(first_ord, n_files, similarity)``: components of two or more videos; similarity 1."""
    return members.groupBy("first_ord").agg(F.count("*").alias("n_files")).filter("n_files >= 2").withColumn("similarity", F.lit(1.0))


def pairs_in_groups(members: DataFrame) -> DataFrame:
    """``(first_ord, a, b)`` for the pairs of each group, for side-by-side comparison of chosen groups."""
    a, b = members.select("first_ord", F.col("ord").alias("a")), members.select("first_ord", F.col("ord").alias("b"))
    return a.join(b, "first_ord").filter("a < b")


def pair_distance(pairs: DataFrame, hashes: DataFrame, column: str = "h") -> DataFrame:
    """``dist`` of each pair's hashes."""
    left = hashes.select(F.col("ord").alias("a"), F.col(column).alias("__x"))
    right = hashes.select(F.col("ord").alias("b"), F.col(column).alias("__y"))
    return pairs.join(left, "a").join(right, "b").withColumn("dist", hamming(F.col("__x"), F.col("__y"))).drop("__x", "__y")


def all_groups(*tables: tuple[str, DataFrame]) -> DataFrame:
    """``(method, first_ord, n_files, similarity, multi_account)`` of several methods under one another, numbered."""
    out = None
    for method, groups in tables:
        multi = F.col("multi_account") if "multi_account" in groups.columns else F.lit(False)
        part = groups.select(F.lit(method).alias("method"), "first_ord", "n_files", "similarity", multi.alias("multi_account"))
        out = part if out is None else out.unionByName(part)
    return number_groups(out, F.asc(method_rank(F.col("method"))), F.asc("first_ord"))
