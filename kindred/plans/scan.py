"""Whole scans: the switched methods over one manifest, and all archives at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.operators import groups as G
from kindred.operators.similarity import cosine_edges, edge_sums, feature_edges, feature_links, hash_nodes, video_edges
from kindred.plans.options import ScanOptions
from kindred.plans.storage import materialise


def perceptual(hashes: DataFrame, options: ScanOptions = ScanOptions(), exclude_exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(groups, members)`` of a table ``scope, ord, md5, h, tp``, from one row for each distinct hash and pair of near hashes."""
    classes, nodes = hash_nodes(hashes, exclude_exact)
    edges = materialise(edge_sums(classes, nodes, options.perceptual_threshold, exclude_exact), "edges")
    members = materialise(G.perceptual_members(hashes, nodes, edges), "members")
    return G.perceptual_groups(hashes, edges, members, options), members


def find_groups(hashes: DataFrame, options: ScanOptions = ScanOptions(), keyframes: DataFrame | None = None, vectors: DataFrame | None = None, descriptors: DataFrame | None = None, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(groups, members)`` of all methods switched on, under one numbering.

    ``hashes``: ``scope, ord, md5, h, tp``. Videos, vectors and descriptors bring their
    own tables and ignore scopes; of descriptors all pairs of files are compared, or the
    ``candidates`` (``a, b``) if given. Without a method there are no groups. Members carry ``method, first_ord, ord, group_id``.
    """
    tables: list[tuple[str, DataFrame]] = []
    members: list[DataFrame] = []

    def add(method: str, groups: DataFrame, own: DataFrame) -> None:
        tables.append((method, groups))
        members.append(own.select(F.lit(method).alias("method"), "first_ord", "ord"))

    if options.exact:
        add("exact", G.exact_groups(hashes), G.exact_members(hashes))
    if options.perceptual:
        add("perceptual", *perceptual(hashes, options))
    if options.feature and descriptors is not None:
        scored = (options.feature_min_score, options.feature_ratio)
        edges = materialise(feature_links(descriptors, *scored) if candidates is None else feature_edges(descriptors, *scored, candidates), "features")
        own = materialise(G.components_of(edges), "members")
        add("feature", G.feature_groups(edges, own), own)
    if options.video and keyframes is not None:
        own = materialise(G.components_of(video_edges(keyframes, options.video_threshold)), "members")
        add("video", G.video_groups(own), own)
    if options.semantic and vectors is not None:
        own = materialise(G.components_of(cosine_edges(vectors, options.semantic_threshold)), "members")
        from kindred.functions.scalars import l2_normalise

        add("semantic", G.semantic_groups(vectors.select("ord", l2_normalise(F.col("v")).alias("unit")), own), own)
    if not tables:
        spark = hashes.sparkSession
        return spark.createDataFrame([], G.GROUPS), spark.createDataFrame([], "method string, first_ord long, ord long, group_id long")
    groups = G.all_groups(*tables)
    every = members[0]
    for m in members[1:]:
        every = every.unionByName(m)
    return groups, every.join(groups.select("method", "first_ord", "group_id"), ["method", "first_ord"])


def scan_archives(hashes: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Exact and perceptual groups of every archive at once (``scope`` is the archive), numbered by archive."""
    exact = G.exact_groups(hashes).select("scope", F.lit("exact").alias("method"), "first_ord", "n_files", "similarity")
    found, _ = perceptual(hashes, options)
    scopes = hashes.select(F.col("ord").alias("first_ord"), "scope")
    near = found.join(scopes, "first_ord").select("scope", F.lit("perceptual").alias("method"), "first_ord", "n_files", "similarity")
    return G.number_groups(exact.unionByName(near), F.asc("scope"), F.asc(G.method_rank(F.col("method"))), F.asc("first_ord")).withColumnRenamed("scope", "archive")
