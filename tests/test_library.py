"""Rules that the queries over the given tables don't reach."""

from __future__ import annotations

import datetime as dt
import io
import random
import struct
import tarfile
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import scalars as S
from kindred.operators import forensics as X, groups as G, images as I, similarity as J, survivors as V
from kindred.operators.components import connected_components
from kindred.plans.options import ScanOptions
from kindred.plans.scan import find_groups, perceptual, scan_archives
from kindred.sources import archives as A, files as M, store as C


def png(px: np.ndarray) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = px.shape
    raw = b"".join(b"\0" + row.tobytes() for row in px.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000)] + [(5000 + i, 5001 + i) for i in range(60)] + [(7000, 7000 + i) for i in range(1, 200)]
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_scalars(spark):
    assert one(spark, S.human_size(F.lit(500))) == "500.0 B"
    assert one(spark, S.human_size(F.lit(1536))) == "1.5 KB"
    assert one(spark, S.human_size(F.lit(5 * 1024**4))) == "5.0 TB"
    assert one(spark, S.shorten_path(F.lit("x" * 60))) == "..." + "x" * 47
    assert one(spark, S.shorten_path(F.lit("x" * 50))) == "x" * 50
    assert one(spark, S.hex_to_long(F.lit("ffffffffffffffff"))) == -1
    assert one(spark, S.long_to_hex(F.lit(-1).cast("long"))) == "f" * 16
    assert one(spark, S.long_to_hex(F.lit(10).cast("long"))) == "000000000000000a"
    assert one(spark, S.suffix(F.lit("/a/B.TAR.GZ"))) == ".tar.gz"
    assert one(spark, S.suffix(F.lit("/a.b/c"))) == ""
    assert one(spark, S.stem(F.lit("/a/b.c.txt"))) == "b.c"
    assert one(spark, S.kind(F.lit("x.Jpeg"))) == "image"
    assert one(spark, S.method_label(F.lit("perceptual"), F.lit(True))) == "Perceptual match (multi-account)"
    assert one(spark, S.source_key(F.array(F.lit("b"), F.lit("a")))) == '["b","a"]'
    assert one(spark, S.percent_text(F.lit(0.984))) == "98.4%"
    assert one(spark, S.keyframe_count(F.lit(100), F.lit(0.0))) == 0
    assert str(one(spark, S.date_of_epoch(F.lit(86400)))) == "1970-01-02"
    assert len(one(spark, S.truncate_text(F.lit("y" * 300)))) == 200


def test_hamming_methods_agree(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(60)]
    rows = []
    for i, b in enumerate(base):
        for k in range(4):
            h = b
            for _ in range(rng.randrange(8)):
                h ^= 1 << rng.randrange(63)
            rows.append((["p", None][i % 2], len(rows), f"m{len(rows) // 2}", h))
    df = spark.createDataFrame(rows, "scope string, ord long, md5 string, h long")
    for t in (0, 3, 7, 11, 20):
        want = {(a[1], b[1], (a[3] ^ b[3]).bit_count()) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[2] != b[2] and (a[3] ^ b[3]).bit_count() <= t}
        assert {tuple(r) for r in J.hamming_edges(df, t).collect()} == want
        fresh = {(a, b, d) for a, b, d in want if a >= 200 or b >= 200}
        assert {tuple(r) for r in J.hamming_edges(df, t, fresh=df.filter("ord >= 200")).collect()} == fresh
    everything = J.hamming_edges(df, 0, exclude_exact=False).count()
    assert everything == sum(a[1] < b[1] and a[0] == b[0] and a[3] == b[3] for a in rows for b in rows)


def test_planned_bands_miss_no_pair():
    """Whatever bits two hashes differ in, some band has no more of them than its flips; bits that never vary spread over bands."""
    rng = random.Random(11)
    for t in (0, 1, 3, 10, 12, 20, 31, 63, 64):
        for n, ones in ((10, None), (10**6, None), (1000, [0] * 30 + [500] * 34)):
            bands = J.plan_bands(t, n, ones)
            assert sorted(b for x in bands for b in x.bits) == list(range(64)) and sum(b.flips + 1 for b in bands) >= t + 1
            for _ in range(200):
                differ = rng.sample(range(64), t)
                assert any(sum(d in b.bits for d in differ) <= b.flips for b in bands)
    spread = J.plan_bands(3, 10**6, [0] * 32 + [500_000] * 32)
    assert max(sum(b >= 32 for b in x.bits) for x in spread) <= 32 // len(spread) + 1


def test_hamming_pairs_of_crowded_bands(spark, monkeypatch):
    """Most hashes share the value of one band; its pairs come from tiles, each once."""
    from kindred.plans import joins

    rng = random.Random(12)
    low = [rng.getrandbits(16) for _ in range(120)] + [rng.getrandbits(63) for _ in range(30)]
    df = spark.createDataFrame([(None, h) for h in low], "scope string, h long")
    bands = [J.Band(tuple(range(16 * k, 16 * k + 16)), f) for k, f in enumerate((2, 1, 1, 1))]
    hashes = sorted(set(low))
    want = {(x, y, (x ^ y).bit_count()) for x in hashes for y in hashes if x < y and (x ^ y).bit_count() <= 8}
    join = joins.join_tiled
    monkeypatch.setattr(J, "join_tiled", lambda a, b, on: join(a, b, on, tile_rows=10))
    found = [(r["x"], r["y"], r["dist"]) for r in J.hamming_pairs(df, 8, bands=bands).collect()]
    assert len(found) == len(want) and set(found) == want
    monkeypatch.setattr(joins, "BROADCAST_KEYS", 0)
    assert {(r["x"], r["y"], r["dist"]) for r in J.hamming_pairs(df, 8).collect()} == want


def test_edges_of_a_wide_threshold_are_made_where_they_are_found(spark, monkeypatch):
    """All files of a scope meet in slices: no edge is shuffled, and common hashes, shared digests and nulls keep their edges."""
    rng = np.random.default_rng(9)
    h = rng.integers(0, 1 << 63, 260, dtype=np.int64)
    h[:60], h[60:90], h[90:120] = h[0], h[0] ^ 5, -h[90:120]
    digests = [None if i % 11 == 0 else f"m{i // 3 if i % 2 else i}" for i in range(260)]
    scopes = [None if i < 200 else ["p", "q", "r"][i % 3] for i in range(260)]
    rows = list(zip(scopes, range(260), digests, h.tolist(), strict=True))
    df = spark.createDataFrame(rows, "scope string, ord long, md5 string, h long")
    monkeypatch.setattr(J, "LEAST_SLICE", 10)
    monkeypatch.setattr(J, "_plan", lambda threshold, *_: ([J.Band((), threshold)], 1.0))
    monkeypatch.setattr(J, "EDGES_AT_ONCE", 37)
    monkeypatch.setattr(J, "MEET_AT_ONCE", 50)
    dist = np.bitwise_count(h.view(np.uint64)[:, None] ^ h.view(np.uint64))
    for t, exclude in ((20, True), (20, False), (29, True), (64, True)):
        want = {(a, b, int(dist[a, b])) for a in range(260) for b in range(a + 1, 260) if scopes[a] == scopes[b] and dist[a, b] <= t and not (exclude and digests[a] == digests[b])}
        found = J.hamming_edges(df, t, exclude_exact=exclude)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan.split("MapInArrow")[0] and plan.count("Exchange") - plan.count("BroadcastExchange") <= 2
    tiles = J.hamming_edges(df, 64).groupBy(F.spark_partition_id()).count().count()
    assert tiles > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert J.hamming_edges(df.limit(0), 30).count() == 0


def test_hamming_pairs_by_many_tasks(spark):
    """Probes of a small table are made and compared by all tasks; bands, tiles and all pairs at once agree, with scopes apart."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 1500, dtype=np.int64)
    h[:400] = h[400:800] ^ (1 << rng.integers(0, 63, 400)) ^ (1 << rng.integers(0, 63, 400))
    h[0], h[1] = -1, -2
    scopes = [["p", None][i % 2] for i in range(len(h))]
    df = spark.createDataFrame(list(zip(scopes, h.tolist(), strict=True)), "scope string, h long")
    dist = np.bitwise_count(h.view(np.uint64)[:, None] ^ h.view(np.uint64))
    apart = np.array([s is None for s in scopes])
    for t, bands in ((10, None), (20, None), (10, J.plan_bands(10, 10**5)), (20, [J.Band((), 20)])):
        i, j = np.nonzero((dist <= t) & (h[:, None] < h) & (apart[:, None] == apart))
        want = {(scopes[a], int(h[a]), int(h[b]), int(dist[a, b])) for a, b in zip(i, j, strict=True)}
        found = J.hamming_pairs(df, t, bands=bands, tile_rows=200)
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(want) and set(rows) == want
        if t == 20:
            assert found.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tiled_join_splits_a_hot_key(spark):
    from kindred.plans.joins import join_tiled

    a = spark.createDataFrame([(i % 7 if i < 30 else 0, i) for i in range(300)], "k int, x long")
    b = spark.createDataFrame([(i % 9 if i < 20 else 0, i) for i in range(200)], "k int, y long")
    met = join_tiled(a, b, ["k"], tile_rows=50)
    assert sorted(map(tuple, met.select("x", "y").collect())) == sorted(map(tuple, a.join(b, "k").select("x", "y").collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = join_tiled(a, b, ["k"], tile_rows=20).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.6 * sum(r["count"] for r in tasks)


def test_blocks_too_far_apart_are_left_out(spark):
    """Clustered vectors: most pairs of blocks are never made, and no edge is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 32))
    v = centres[rng.integers(0, 12, 600)] + 0.1 * rng.normal(size=(600, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if i < j}
    rows, pairs, skipped = J.cosine_blocks(df, 0.9, block_rows=25)
    n = rows.select("block").distinct().count()
    assert 24 <= n <= 40 and pairs.count() == round((1 - skipped) * n * (n + 1) / 2) and skipped > 0.6
    assert {(r["a"], r["b"]) for r in J.cosine_edges(df, 0.9, block_rows=25).collect()} == want
    assert J.cosine_edges(df.limit(0)).count() == 0


def test_ranges_of_many_blocks_are_looked_at_together(spark, monkeypatch):
    from kindred.operators import tiles

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(size=200) * 100)], "ord long, x double")
    rows = tiles.in_blocks(df, F.asc("x"), block_rows=5)
    d = F.array(F.col("x"))
    fine, _ = tiles.block_pairs(rows, d, 3.0)
    monkeypatch.setattr(tiles, "MAX_RANGES", 7)
    coarse, _ = tiles.block_pairs(rows, d, 3.0)
    fine, coarse = ({tuple(r) for r in t.collect()} for t in (fine, coarse))
    assert fine < coarse and len(coarse) < 40 * 41 / 2 and all(i <= j for i, j in coarse)


def test_cosine_blocks_grow_with_the_table(spark, monkeypatch):
    """A large table has a bounded number of blocks until they are full, and a block is compared in parts."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord long, v array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(u @ u.T >= 0.85, 1)), strict=True)}
    monkeypatch.setattr(J, "BLOCK_ROWS", 10)
    monkeypatch.setattr(J, "BLOCKS", 4)
    rows, _, _ = J.cosine_blocks(df, 0.85, pivots=1)
    assert rows.select("block").distinct().count() == 4
    assert {(r["a"], r["b"]) for r in J.cosine_edges(df).collect()} == want
    monkeypatch.setattr(J, "BLOCK_NUMBERS", 6 * 50)
    assert J.cosine_blocks(df, 0.85, pivots=1)[0].select("block").distinct().count() == 8


def test_wide_vectors_are_normalised_in_linear_time(spark):
    """A vector's length is taken once, not once for each number."""
    import time

    df = spark.range(100).selectExpr("id AS ord", "transform(sequence(1, 4000), x -> CAST(x * (id + 1) AS DOUBLE)) AS v")
    began = time.perf_counter()
    found = df.select("ord", S.l2_normalise(F.col("v")).alias("u")).selectExpr("ord", "aggregate(u, 0D, (s, x) -> s + x * x) AS n", "u[1] / u[0] AS r").collect()
    assert time.perf_counter() - began < 30
    assert len(found) == 100 and all(abs(r["n"] - 1) < 1e-9 and abs(r["r"] - 2) < 1e-9 for r in found)
    odd = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, []), (3, [3.0, 4.0])], "ord long, v array<double>")
    assert [r["u"] for r in odd.select("ord", S.l2_normalise(F.col("v")).alias("u")).orderBy("ord").collect()] == [[0.0, 0.0], None, [], [0.6, 0.8]]


def test_bounds_of_cosines_lose_no_pair(monkeypatch):
    """However many numbers a bound has and wherever the vectors' weight lies, the pairs are those of all products."""
    rng, chosen = np.random.default_rng(13), J._width
    for scale in (np.ones(40), np.geomspace(1, 1e-4, 40)):
        x = rng.normal(size=(300, 40)) * scale
        x[150:] = x[:150] + 0.4 * rng.normal(size=(150, 40)) * scale
        x /= np.linalg.norm(x, axis=1)[:, None]
        exact = (x[:, None] * x).sum(axis=2)
        monkeypatch.setattr(J, "LEFT_ROWS", 37)
        monkeypatch.setattr(J, "RIGHT_ROWS", 50)
        monkeypatch.setattr(J, "CHECKED_ROWS", 11)
        for width in (1, 5, 20, 40, None):
            monkeypatch.setattr(J, "_width", (lambda *_, w=width: w) if width else chosen)
            for threshold in (0.85, float(exact[0, 150]), -1.0):
                for other, same, want in ((x, True, np.triu(exact >= threshold, 1)), (x[:99], False, exact[:, :99] >= threshold)):
                    parts = list(J._near_vectors(x, other, threshold, same))
                    got = [(int(i), int(j)) for p in parts for i, j in zip(p[0], p[1], strict=True)]
                    assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(want)), strict=True))
        monkeypatch.undo()


def test_semantic_groups_of_vectors_of_any_width(spark):
    from kindred.operators import groups as G

    rng = np.random.default_rng(14)
    for width in (3, 64, 150):
        v = rng.normal(size=(12, width))
        v /= np.linalg.norm(v, axis=1)[:, None]
        vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, unit array<double>")
        members = spark.createDataFrame([(i, 0 if i < 7 else 7) for i in range(12)], "ord long, first_ord long")
        got = {r["first_ord"]: (r["n_files"], r["similarity"]) for r in G.semantic_groups(vectors, members).collect()}
        for first, own in ((0, v[:7]), (7, v[7:])):
            mean = np.mean([own[i] @ own[j] for i in range(len(own)) for j in range(i)])
            assert got[first][0] == len(own) and abs(got[first][1] - mean) < 1e-12


def test_cosine_blocks(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8))
    v[60:] = v[:60] + 0.2 * rng.normal(size=(60, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, v array<double>")
    n = np.linalg.norm(v, axis=1)
    c = v @ v.T / np.where(n > 0, n, 1)[:, None] / np.where(n > 0, n, 1)
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if c[i, j] >= 0.85}
    for rows in (16, 4096):
        assert {(r["a"], r["b"]) for r in J.cosine_edges(df, block_rows=rows).collect()} == want
    found = {(r["a"], r["b"]) for r in J.cosine_candidates(df, width=2.0, tables=12).collect()}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_group_statistics(spark):
    """Closed forms against pairs; a pair without an edge counts as distance zero unless told otherwise."""
    hashes = spark.createDataFrame([(0, 0, 0), (1, 0b111, 0b11), (2, 0b111111, 0)], "ord long, h long, tp long")
    edges = spark.createDataFrame([(0, 1, 3, 2), (1, 2, 3, 2)], "a long, b long, dist int, dist_top int")
    members = G.components_of(edges)
    r = G.perceptual_groups(hashes, edges, members).first()
    assert (r["n_files"], r["avg_full"], round(r["avg_top"], 6)) == (3, 4.0, round(4 / 3, 6))
    assert r["similarity"] == round(1 - (2 * (0.8 * 3 + 0.2 * 2) / 3) / 64, 3) and not r["multi_account"]
    seen = G.perceptual_groups(hashes, edges, members, missing_pair="observed").first()
    assert seen["similarity"] == round(1 - 2.8 / 64, 3)
    assert [tuple(x) for x in G.pairs_in_groups(members).select("a", "b").orderBy("a", "b").collect()] == [(0, 1), (0, 2), (1, 2)]


def test_scopes(spark):
    files = spark.createDataFrame([(0, "d1", "x"), (1, "d1", "x"), (2, "d2", "x"), (3, None, "x"), (4, None, None)], "ord long, source_group string, md5 string")
    scoped = G.comparable(G.assign_scope(files))
    assert sorted(r["ord"] for r in scoped.collect()) == [0, 1, 3, 4]
    assert [(r["scope"], r["n_files"]) for r in G.exact_groups(scoped).collect()] == [("d1", 2)]
    assert G.exact_groups(G.assign_scope(files, cross_doc=True)).first()["n_files"] == 4


def test_all_methods_one_numbering(spark):
    hashes = spark.createDataFrame([(None, 0, "a", 0, 0), (None, 1, "a", 0, 0), (None, 2, "b", 3, 0), (None, 3, "c", 2**60 - 1, 0)], "scope string, ord long, md5 string, h long, tp long")
    keyframes = spark.createDataFrame([(v, i, 7 * i) for v in (1, 2) for i in range(4)], "video long, frame_idx long, h long")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])], "ord long, v array<double>")
    groups, members = find_groups(hashes, ScanOptions(video=True, semantic=True), keyframes=keyframes, vectors=vectors)
    assert [(r["group_id"], r["method"], r["n_files"]) for r in groups.orderBy("group_id").collect()] == [(1, "exact", 2), (2, "perceptual", 3), (3, "video", 2), (4, "semantic", 2)]
    assert members.count() == 9
    assert scan_archives(hashes.withColumn("scope", F.lit("z.zip"))).count() == 2


def test_plans(spark):
    rows = [(1, 0, "/p/a.txt", 9, 1, 1, 5), (1, 1, "/q/a.txt", 9, 1, 1, 6), (1, 2, "/r/a.txt", 9, None, 1, 7), (2, 3, "/s/a_1.txt", 1, 1, 1, 1), (2, 4, "/s/b.txt", 5, 1, 1, 1)]
    members = spark.createDataFrame(rows, "group_id long, ord long, path string, length long, width int, height int, mtime long")
    assert [r["ord"] for r in V.keep_best(members).orderBy("group_id").collect()] == [1, 4]
    assert [r["ord"] for r in V.keep_best(members, use_mtime=False).orderBy("group_id").collect()] == [0, 4]
    existing = spark.createDataFrame([("/t", "a.txt")], "dir string, name string")
    plan = {r["ord"]: r["target"] for r in V.move_plan(members, "/t", existing=existing).collect()}
    assert len(set(plan.values())) == 3 and "/t/a.txt" not in plan.values() and plan[3] == "/t/a_1.txt"
    renamed = V.rename_plan(members, "g", 5)
    assert {r["ord"]: r["target"] for r in renamed.collect()}[1] == "/q/g1_006.txt"
    assert {r["path"] for r in V.apply_renames(members, renamed).collect()} == {r["target"] for r in renamed.collect()}
    left = V.remove_files(members, members.filter("ord in (0, 3)"))
    assert sorted(r["ord"] for r in left.collect()) == [1, 2]
    assert V.preview(members, 2)[1] == 3
    assert V.sorted_results(members.withColumn("similarity", F.col("length")), descending=False).first()["ord"] == 3


def test_plans_of_large_groups(spark):
    """Over a thousand files of one group and one name; existing names repeated."""
    members = spark.range(1200).selectExpr("1L AS group_id", "id AS ord", "concat('/p/', IF(id % 3 = 0, 'a', 'b'), '.jpg') AS path", "id % 7 AS length", "1 AS width", "1 AS height", "id AS mtime")
    plan = V.rename_plan(members, "g").collect()
    assert len({r["target"] for r in plan}) == 1200 and {r["ord"]: r["target"] for r in plan}[1199] == "/p/g1_1200.jpg"
    taken = spark.createDataFrame([("/p", "g1_001.jpg"), ("/p", "g1_001.jpg"), ("/p", "g1_001_1.jpg"), ("/t", "a.jpg"), ("/t", "a.jpg")], "dir string, name string")
    plan = {r["ord"]: r["target"] for r in V.rename_plan(members, "g", existing=taken).collect()}
    assert len(set(plan.values())) == len(plan) == 1200 and plan[0] == "/p/g1_001_2.jpg" and plan[1] == "/p/g1_002.jpg"
    own = members.filter("ord = 5").withColumn("path", F.lit("/p/g1_001.jpg"))
    assert V.rename_plan(own, "g", existing=taken).first()["target"] == "/p/g1_001.jpg"
    moved = [r["target"] for r in V.move_plan(members, "/t", existing=taken).collect()]
    assert len(set(moved)) == len(moved) == 1199 and "/t/a.jpg" not in moved
    assert [r["ord"] for r in V.keep_best(members).collect()] == [1196] and V.duplicates(members).count() == 1199
    row = V.delete_plan(members).first()
    assert (row["n_delete"], row["bytes_reclaimed"]) == (1199, sum(i % 7 for i in range(1200)) - 6)
    assert [(r["rank"], r["ord"]) for r in V.ranked(members).orderBy("rank").limit(2).collect()] == [(1, 1196), (2, 1189)]


def test_one_hash_of_thousands(spark):
    """A blank picture's hash, held by thousands of different files, and a near one: groups as by all pairs."""
    rng = random.Random(5)
    rows = [(None, i, f"m{i % 1500}", 0, rng.getrandbits(8)) for i in range(3000)] + [(None, 5000 + i, f"m{i % 3}", 7, 1) for i in range(9)] + [(None, 9000, "z", 2**40 - 1, 0), (None, 9001, "z", 2**40 - 1, 0), (None, 9002, None, 2**50 + 2**41, 5)]
    few = [r for r in rows if r[1] % 100 == 0 or r[1] >= 5000]
    schema = "scope string, ord long, md5 string, h long, tp long"
    for part, exclude in ((few, True), (few, False)):
        df = spark.createDataFrame(part, schema)
        found, members = perceptual(df, exclude_exact=exclude)
        edges = J.hamming_edges(df, 10, exclude_exact=exclude)
        want = {tuple(r) for r in G.components_of(edges).collect()}
        assert {tuple(r) for r in members.select("ord", "first_ord").collect()} == want
        top = G.pair_distance(edges.select("a", "b"), df, "tp").withColumnRenamed("dist", "dist_top")
        plain = G.perceptual_groups(df, edges.join(top, ["a", "b"]), members)
        close = lambda t: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect())
        assert close(found) == close(plain)
        total = lambda t: t.agg(*[F.sum(c) for c in t.columns]).first()
        classes, nodes = J.hash_nodes(df, exclude)
        assert total(J.edge_sums(classes, nodes, 10, exclude).select("n", "dist", "dist_top")) == total(edges.join(top, ["a", "b"]).select(F.lit(1).alias("n"), "dist", "dist_top"))
    found, members = perceptual(spark.createDataFrame(rows, schema))
    assert found.first()["n_files"] == 3010 == members.count()  # the one without a digest is near, the two copies far off



def test_descriptors_need_two_keypoints(spark):
    words = spark.createDataFrame([("a", 0, 0, 0, 0, 0), ("b", 0, 0, 0, 0, 0), ("b", 1, -1, -1, 0, 0)], "file string, kp long, w0 long, w1 long, w2 long, w3 long")
    pairs = spark.createDataFrame([("a", "b"), ("a", "none")], "a string, b string")
    assert {(r["b"], r["score"], r["good"]) for r in J.descriptor_matches(words, pairs).collect()} == {("b", 0.0, 1), ("none", 0.0, 0)}


def plain_scores(files, ratio=0.75):
    """Every pair of files, every keypoint's two nearest by sorting."""
    out = {}
    for a in files:
        for b in files:
            if a < b:
                good = 0
                for x in files[a]:
                    d = sorted(sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True)) for y in files[b])
                    good += len(d) > 1 and d[0] < ratio * d[1]
                least = min(len(files[a]), len(files[b]))
                if good:
                    out[a, b] = (len(files[a]), len(files[b]), good, 0.0 if least < 2 else round(min(1.0, good / least), 3))
    return out


def test_descriptor_scores_equal_all_pairs(spark):
    """Files of one to nine keypoints, ties, repeats within a file, near and far files; blocks of a few keypoints."""
    rng = random.Random(13)
    word = lambda: rng.getrandbits(64) - (1 << 63)
    files = {f"f{i:02d}": [tuple(word() for _ in range(4)) for _ in range(rng.randrange(1, 10))] for i in range(24)}
    for i in range(8):
        files[f"g{i}"] = [tuple(w ^ (1 << rng.randrange(63)) for w in x) for x in files[f"f{i:02d}"]][: rng.randrange(1, 9)] + [(0, 0, 0, 0)] * (i % 3)
    rows = [(f, k, *x) for f, kps in files.items() for k, x in enumerate(kps)] + [("null", 0, None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "file string, kp long, w0 long, w1 long, w2 long, w3 long").repartition(3)
    signed = {f: [tuple(w & (1 << 64) - 1 for w in x) for x in kps] for f, kps in files.items()}
    want = plain_scores(signed)
    for size in (7, 4096):
        found = {(r["a"], r["b"]): tuple(r)[2:] for r in J.descriptor_scores(df, block_rows=size).collect()}
        assert found == want
    assert J.descriptor_scores(df.limit(0)).count() == 0
    near = {k for k, v in want.items() if v[3] >= 0.15}
    assert {(r["a"], r["b"]) for r in J.feature_edges(df).collect()} == near
    candidates = J.candidate_pairs(df, tile_rows=4)
    met = {(r["a"], r["b"]) for r in J.feature_edges(df, pairs=candidates).collect()}
    assert met <= near and {(f"f{i:02d}", f"g{i}") for i in range(8) if (f"f{i:02d}", f"g{i}") in near} <= met


def test_links_of_files_are_their_edges_added_up(spark):
    rng = random.Random(17)
    base = [[rng.getrandbits(16) for _ in range(4)] for _ in range(40)]
    rows = [(f * 3, k, *[w ^ (1 << rng.randrange(16)) for w in rng.choice(base[f % 5 :: 5])]) for f in range(60) for k in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "file long, kp long, w0 long, w1 long, w2 long, w3 long")
    for least in (0.15, 0.6):
        edges = J.feature_edges(df, least).cache()
        want = {tuple(r) for r in G.feature_groups(edges, G.components_of(edges)).collect()}
        for size in (40, None):
            links = J.feature_links(df, least, block_rows=size).cache()
            assert {tuple(r) for r in G.feature_groups(links, G.components_of(links)).collect()} == want
            assert links.agg(F.sum("n")).first()[0] == (edges.count() or None)
            assert size is not None or links.count() <= 60 or edges.count() < 60
    assert J.feature_links(df.limit(0)).count() == 0


def test_blocks_of_files_are_compared_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(J, "TASK_PAIRS", 1000)
    rows = [(f, k, f * 977 + k * 31, f, k, 0) for f in range(60) for k in range(4)]
    df = spark.createDataFrame(rows, "file long, kp long, w0 long, w1 long, w2 long, w3 long")
    found = J.descriptor_scores(df, block_rows=16)
    assert found.rdd.getNumPartitions() == 28


def test_candidates_of_the_given_table(spark):
    """The inverted file of 16-bit bands finds at least nine in ten of the edges that all pairs have."""
    from kindred.plans import fixtures as T

    words = T.descriptors(spark, "/root/testdata/sf0.001")
    want = {(r["a"], r["b"]) for r in J.feature_edges(words).collect()}
    met = {(r["a"], r["b"]) for r in J.feature_edges(words, pairs=J.candidate_pairs(words)).collect()}
    assert met <= want and len(met) >= 0.9 * len(want) > 100


def test_a_scan_without_methods_finds_nothing(spark):
    from kindred.plans.options import ScanOptions
    from kindred.plans.scan import find_groups

    hashes = spark.createDataFrame([(None, 1, "a", 1, 1)], "scope string, ord long, md5 string, h long, tp long")
    groups, members = find_groups(hashes, ScanOptions(exact=False, perceptual=False))
    full, own = find_groups(hashes)
    assert groups.count() == members.count() == 0
    assert set(groups.columns) == set(full.columns) and set(members.columns) == set(own.columns)


def test_candidate_pairs(spark):
    rng = random.Random(8)
    rows = [(f"f{i // 5}", i % 5, *(rng.getrandbits(63) for _ in range(4))) for i in range(60)]
    rows += [(f"g{i}", 0, r[2] ^ (1 << 5), r[3] ^ (1 << 60), r[4], r[5] ^ 7) for i, r in enumerate(rows[:8])]
    df = spark.createDataFrame(rows, "file string, kp long, w0 long, w1 long, w2 long, w3 long")
    bands = lambda r: {(k, b, r[2 + k] >> 16 * b & 0xFFFF) for k in range(4) for b in range(4)}
    want = {(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and bands(x) & bands(y)}
    assert {tuple(r) for r in J.candidate_pairs(df).collect()} == want >= {(f"f{i // 5}", f"g{i}") for i in range(8)}


def test_store(spark):
    cache = spark.createDataFrame([("p", 1, 1, "h", 1.0), ("q", 1, 1, "", 1.0)], "path string, length long, mtime long, phash_top string, computed_at double")
    files = spark.createDataFrame([("p", 1, 1), ("q", 1, 1), ("p", 2, 1)], "path string, length long, mtime long")
    hits, misses = C.cache_lookup(files, cache)
    assert hits.count() == 1 and misses.count() == 2
    import datetime as dt

    now = dt.datetime(2024, 1, 2)
    log = C.open_session(spark, 1, ["a"], now)
    closed = C.close_session(log, 1, spark.createDataFrame([(2,), (3,)], "n_files long"), now).first()
    assert (closed["total_files"], closed["total_groups"], closed["source_key"]) == (5, 2, '["a"]')
    assert C.last_session(log, '["a"]').count() == 0


def test_replace_reads_before_it_writes(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(at)
    C.replace_table(spark.read.parquet(at).withColumn("id", F.col("id") + 1), at)
    assert sorted(r["id"] for r in spark.read.parquet(at).collect()) == [1, 2, 3]
    C.clear_table(spark, at)
    assert spark.read.parquet(at).count() == 0


@pytest.fixture
def pictures(tmp_path):
    rng = np.random.default_rng(3)
    smooth = np.clip(128 + 90 * np.sin(np.linspace(0, 5, 64))[:, None] * np.cos(np.linspace(0, 4, 48))[None], 0, 255).astype(np.uint8)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(png(smooth))
    (tmp_path / "sub" / "copy.png").write_bytes(png(smooth))
    (tmp_path / "b.png").write_bytes(png(np.clip(smooth.astype(int) + 9, 0, 255)))
    (tmp_path / "c.png").write_bytes(png(rng.integers(0, 256, (64, 48))))
    (tmp_path / "broken.jpg").write_bytes(b"not a picture")
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "note.txt").write_text("x")
    return tmp_path


def test_fingerprint_job(spark, pictures):
    files = M.list_files(spark, str(pictures), content=True)
    assert files.count() == 6
    good, bad = C.split_errors(M.size_guards(files, most=10**6))
    assert [(r["path"].rsplit("/", 1)[-1], r["error_type"]) for r in bad.collect()] == [("empty.png", "EmptyFile")]
    sized = spark.createDataFrame([("e", 0), ("n", None), ("b", 10**6 + 1), ("g", 5)], "path string, length long")
    assert {r["path"]: r["error_type"] for r in C.split_errors(M.size_guards(sized, most=10**6))[1].collect()} == {"e": "EmptyFile", "n": "EmptyFile", "b": "FileTooLarge"}
    cache = spark.createDataFrame([], "path string, length long, mtime timestamp, md5 string, sha256 string, phash string, dhash string, ahash string, phash_top string, width long, height long, computed_at double")
    found, errors, new = I.fingerprint(files, I.read_images(spark, str(pictures)), cache)
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in found.collect()}
    assert set(rows) == {"a.png", "copy.png", "b.png", "c.png"} and sorted(r["error_type"] for r in errors.collect()) == ["EmptyFile", "UndecodableImage"]
    far = lambda a, b, k: (int(rows[a][k], 16) ^ int(rows[b][k], 16)).bit_count()
    for k in ("phash", "dhash", "ahash"):
        assert far("a.png", "copy.png", k) == 0 and far("a.png", "b.png", k) <= 6 < far("a.png", "c.png", k)
    assert rows["a.png"]["md5"] == rows["copy.png"]["md5"] and (rows["a.png"]["width"], rows["a.png"]["height"]) == (48, 64)
    again, _, _ = I.fingerprint(good, I.read_images(spark, str(pictures)), new)
    assert again.count() == 4
    first = I.read_images(spark, str(pictures)).filter("width > 0").select("path", I.hash_udf("phash")("height", "width", "nChannels", "data").alias("h")).collect()
    assert {r["path"].rsplit("/", 1)[-1]: f"{r['h'] & (1 << 64) - 1:016x}" for r in first} == {k: v["phash"] for k, v in rows.items()}


def test_forensic_figures(spark, pictures):
    images = I.read_images(spark, str(pictures))
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in X.single_figures(images).collect()}
    assert rows["broken.jpg"]["noise"] is None and rows["c.png"]["noise"] > 10 * rows["a.png"]["noise"]
    assert abs(sum(rows["a.png"]["histogram"]) - 1) < 1e-9 and rows["c.png"]["ela_mean"] > rows["a.png"]["ela_mean"]
    root = str(pictures)
    pairs = spark.createDataFrame([(f"{root}/a.png", f"{root}/sub/copy.png"), (f"{root}/a.png", f"{root}/c.png")], "a string, b string")
    same, other = sorted(X.pair_figures(pairs, images).collect(), key=lambda r: r["diff_mean"])
    assert (same["diff_mean"], same["edge_agreement"], same["histogram_correlation"]) == (0.0, 1.0, 1.0) and other["diff_mean"] > 20
    assert X.edge_share(np.zeros((9, 9))) == 0 and X.edge_share(np.kron(np.eye(2), np.full((8, 8), 255.0))) > 0


def test_group_figures_are_those_of_pictures_and_pairs(spark, pictures):
    """Tiles of two pictures: each pair once, figures as from the single and the pair tables; a broken picture's are null."""
    images = I.read_images(spark, str(pictures))
    paths = sorted(r["path"] for r in images.collect())
    members = spark.createDataFrame([(7, p) for p in paths * 2] + [(8, paths[0]), (9, paths[0]), (9, paths[1])], "group_id int, path string")
    tags = spark.createDataFrame([(paths[0], {"x": "1", "y": "2"}), (paths[1], {"x": "1"})], "path string, metadata map<string,string>")
    single = {r["path"]: r for r in X.single_figures(images).collect()}
    pairs = [(a, b) for a in paths for b in paths if a < b]
    both = {(r["a"], r["b"]): r for r in X.pair_figures(spark.createDataFrame(pairs, "a string, b string"), images).collect()}
    found = X.group_figures(members, images, tags, tile=2).collect()
    assert sorted((r["group_id"], r["a"], r["b"]) for r in found) == sorted([(7, *p) for p in pairs] + [(9, paths[0], paths[1])])
    for r in found:
        a, b, plain = single[r["a"]], single[r["b"]], both[r["a"], r["b"]]
        for c in ("noise", "ela_mean", "ela_max", "ela_bright", "edge_share"):
            assert (r[f"{c}_a"], r[f"{c}_b"]) == (a[c], b[c])
        assert all(r[c] == plain[c] for c in ("diff_mean", "diff_max", "diff_percent", "edge_agreement", "histogram_correlation"))
        assert (r["ela_diff_mean"] is None) == (plain["diff_mean"] is None)
        assert r["differing"] == (["y"] if (r["a"], r["b"]) == (paths[0], paths[1]) else ["x", "y"] if r["a"] == paths[0] else ["x"] if r["a"] == paths[1] else [])
    same = next(r for r in found if r["diff_mean"] == 0)
    assert same["ela_diff_max"] == 0


def test_cache_table(spark, tmp_path):
    """Only touched parts are written, a lookup shuffles the files only, and another session's table finds the rows."""
    from pathlib import Path

    schema = "path string, length long, mtime timestamp, md5 string, phash_top string, computed_at double"
    stamp = dt.datetime(2024, 1, 1)
    rows = [(f"p{i}", i, stamp, f"m{i}", f"t{i}", 1.0) for i in range(200)]
    table = C.CacheTable(spark, "cache_a", f"file://{tmp_path}/cache", schema, parts=4, buckets=4)
    assert table.upsert(spark.createDataFrame(rows, schema)) == [0, 1, 2, 3]
    files = lambda: {str(p): p.stat().st_mtime_ns for p in Path(tmp_path, "cache").rglob("*.parquet")}
    before = files()
    written = table.upsert(spark.createDataFrame([("p5", 5, stamp, "m5", "again", 2.0), ("p5", 6, stamp, "m", "other", 1.0), ("p5", 5, stamp, "m5", "older", 0.5)], schema))
    after = files()
    assert len(written) == 1 and {p for p in before if f"part={written[0]}/" not in p} == {p for p in after if f"part={written[0]}/" not in p}
    assert all(before[p] == after[p] for p in before if p in after) and not {p for p in before if f"part={written[0]}/" in p} & set(after)
    want = {r[:2]: r[4] for r in rows} | {("p5", 5): "again", ("p5", 6): "other"}
    assert {(r["path"], r["length"]): r["phash_top"] for r in table.rows().collect()} == want
    wanted = spark.createDataFrame([("p5", 5, stamp), ("p7", 8, stamp), ("new", 1, stamp)], "path string, length long, mtime timestamp")
    again = C.CacheTable(spark, "cache_b", f"file://{tmp_path}/cache", schema, parts=4, buckets=4)
    hits, misses = again.lookup(wanted)
    assert [r["phash_top"] for r in hits.collect()] == ["again"] and {r["path"] for r in misses.collect()} == {"p7", "new"}
    assert again.upsert(spark.createDataFrame([], schema)) == []
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = again.lookup(wanted)[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = plan.index("cache_b")
    assert "Join" in plan and plan.count("Exchange") == 1 and plan.index("Exchange") < scan and "Bucketed: true" in plan


def test_empty_files_reach_the_error_table(spark, tmp_path):
    for name, data in (("a.png", b"12"), ("empty.png", b""), ("sub/deep/none.jpg", b""), ("sub/b.png", b"1"), ("sub/x.txt", b"")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for uri in (str(tmp_path), f"file://{tmp_path}"):
        listed = M.list_files(spark, uri)
        good, bad = C.split_errors(M.size_guards(listed))
        assert {r["path"] for r in good.collect()} == {f"{tmp_path}/a.png", f"{tmp_path}/sub/b.png"}
        assert {(r["path"], r["error_type"]) for r in bad.collect()} == {(f"{tmp_path}/empty.png", "EmptyFile"), (f"{tmp_path}/sub/deep/none.jpg", "EmptyFile")}
    from kindred.sources.listing import every_file

    for folders in (1, 2, 100):
        assert every_file(spark, str(tmp_path), folders).count() == 5
    assert {r["path"]: bytes(r["content"]) for r in M.list_files(spark, str(tmp_path), content=True).collect()}[f"{tmp_path}/empty.png"] == b""
    assert M.list_files(spark, f"{tmp_path}/empty.png").first()["length"] == 0
    seen = M.list_files(spark, str(tmp_path)).select("path", F.col("mtime").cast("double").alias("t")).collect()
    assert all(abs(r["t"] - __import__("os").stat(r["path"]).st_mtime) < 1 for r in seen)


def test_manifest_sources(spark, pictures):
    a, b = M.list_files(spark, str(pictures / "sub")), M.list_files(spark, str(pictures))
    both = M.union_sources(a, b).orderBy("ord").collect()
    assert [r["ord"] for r in both] == list(range(6)) and both[0]["source_ord"] == 0
    assert M.list_files(spark, str(pictures / "a.png")).count() == 1
    assert M.list_files(spark, str(pictures), kinds=("video",)).count() == 0
    video = spark.createDataFrame([("/v.mp4",), ("/w.mp4",)], "path string")
    meta = spark.createDataFrame([("/v.mp4", 480, 24.0)], "path string, frames long, fps double")
    assert [(r["duration"], r["keyframe_count"]) for r in M.video_manifest(video, meta).orderBy("path").collect()] == [(20.0, 10), (0.0, 0)]


def test_archives(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.png", b"12345")
        f.writestr("dir/", b"")
        f.writestr("big.png", b"x" * 100)
        f.writestr("c.txt", b"t")
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("m.png")
        info.size = 3
        f.addfile(info, io.BytesIO(b"abc"))
    x = io.BytesIO()
    with zipfile.ZipFile(x, "w") as f:
        f.writestr("xl/media/image1.png", b"img")
        f.writestr("xl/drawings/_rels/drawing1.xml.rels", '<Relationship Id="rId1" Target="../media/image1.png"/>')
        f.writestr("xl/drawings/drawing1.xml", '<a r:embed="rId1"/><b r:embed="rId1"/>')
    import gzip

    rows = [("/a.zip", z.getvalue()), ("/b.tar.gz", t.getvalue()), ("/c.xlsx", x.getvalue()), ("/d.rar", b"??"), ("/e.png.gz", gzip.compress(b"zz")), ("/f.zip", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    found = A.explode_archives(df, ScanOptions(max_member_bytes=50), media_only=True).collect()
    ok = sorted((r["archive"], r["member"]) for r in found if r["error_type"] is None)
    assert ok == [("/a.zip", "a.png"), ("/b.tar.gz", "m.png"), ("/c.xlsx", "xl/media/image1.png"), ("/c.xlsx", "xl/media/image1.png"), ("/e.png.gz", "e.png")]
    assert sorted((r["archive"], r["error_type"]) for r in found if r["error_type"]) == [("/a.zip", "MemberTooLarge"), ("/d.rar", "ValueError"), ("/f.zip", "ValueError")]
    tight = A.explode_archives(df.filter("path = '/a.zip'"), ScanOptions(max_archive_bytes=50))
    assert [(r["member"], r["error_type"]) for r in tight.collect()] == [("a.png", None), ("big.png", "BudgetExceeded")]
    assert A.manifest_of(tight).first()["path"] == "/a.zip/a.png"


def test_nested_archives_at_any_depth(spark):
    data, name = b"leaf", "leaf.txt"
    for depth in range(7):
        z = io.BytesIO()
        with zipfile.ZipFile(z, "w") as f:
            f.writestr(name, data)
        data, name = z.getvalue(), f"level{depth}.zip"
    df = spark.createDataFrame([("/top.zip", data)], "path string, content binary")
    rows = A.expand_nested(df).collect()
    assert [(r["member"], bytes(r["content"]), r["error_type"]) for r in rows] == [("leaf.txt", b"leaf", None)]
    for depth in (1, 3):
        rows = A.expand_nested(df, max_depth=depth).collect()
        assert [(r["member"], r["content"], r["error_type"]) for r in rows] == [(f"level{6 - depth}.zip", None, "TooDeep")]


def test_tables_are_removed(spark):
    import os

    from kindred.plans.storage import discard, materialise, scratch

    where = lambda t: t.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    kept = materialise(spark.range(3))
    with scratch(spark):
        inner = where(materialise(spark.range(4)))
        assert os.path.isdir(inner)
    assert not os.path.isdir(inner) and kept.count() == 3
    at = where(kept)
    discard(kept)
    assert not os.path.isdir(at)


def test_free_names_take_the_smallest_numbers(spark):
    """Against trying one number after the other: thousands taken, gaps, names that look numbered, many rows for one name."""
    rng = random.Random(21)
    wanted = [(i, f"/s/{i}", "/t", rng.choice(["a.jpg", "a_1.jpg", "a_7.jpg", "b", ".hidden", "x.tar.gz", "c_01.png", "A.JPG"])) for i in range(400)]
    taken = [("/t", f"a_{k}.jpg") for k in range(1, 3000) if rng.random() < 0.9] + [("/t", n) for n in ("a.jpg", "b_2", "b", "c_01_1.png", "x.tar_1.gz", "a_03.jpg", "a_99999999999999999999.jpg", ".hidden_1")] + [("/u", "A.JPG")]
    held, want, late = set(taken), {}, []
    for i, _, d, n in wanted:
        if (d, n) in held:
            late.append((i, d, n))
        else:
            held.add((d, n))
            want[i] = f"{d}/{n}"
    for i, d, n in late:
        dot = n.rfind(".")
        head, tail = (n[:dot], n[dot:]) if dot > 0 else (n, "")
        k = next(k for k in range(1, 10_000) if (d, f"{head}_{k}{tail}") not in held)
        held.add((d, f"{head}_{k}{tail}"))
        want[i] = f"{d}/{head}_{k}{tail}"
    rows = spark.createDataFrame(wanted, "ord long, path string, dir string, name string")
    existing = spark.createDataFrame(taken * 2, "dir string, name string")
    assert {r["ord"]: r["target"] for r in V.unique_targets(rows, existing).collect()} == want
    assert V.unique_targets(rows.limit(0), existing).count() == 0
    alone = {r["ord"]: r["target"] for r in V.unique_targets(rows).collect()}
    assert len(set(alone.values())) == 400


def test_metadata(spark):
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + struct.pack("<HHI4s", 271, 2, 3, b"ab\0\0") + struct.pack("<I", 0)
    df = spark.createDataFrame([("a", tiff), ("b", b""), ("c", None)], "path string, content binary")
    assert {r["path"]: r["metadata"] for r in X.ifd0_metadata(df).collect()} == {"a": {"271": "ab"}, "b": {}, "c": {}}


def test_user_functions(spark):
    df = spark.createDataFrame([("p", b"ab"), ("q", b"")], "path string, content binary")

    def model(items):
        return [np.array([len(x), 1 / len(x)]) for x in items]

    rows = {r["path"]: r["v"] for r in df.select("path", I.embed(model)("content").alias("v")).collect()}
    assert rows == {"p": [2.0, 0.5], "q": None}
    assert I.describe(df, lambda c: np.zeros((len(c), 32), np.uint8)).count() == 2
