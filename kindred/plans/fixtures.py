"""Inputs of the registered queries: columns that the given tables lack, derived by arithmetic.

``SQL`` holds the same tables for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS ord", "concat(source, '/', doc_id, '/', n_chars % 97, '.txt') AS path", "source AS scope", "md5(text) AS md5", "n_chars AS length",
        "n_chars % 97 + 1 AS width", "doc_id % 13 + 1 AS height", "TIMESTAMP'2024-01-01' + make_dt_interval(0, 0, 0, doc_id) AS mtime",
    )


def sign_bits(first: int, n: int, shift: int = 0) -> str:
    return f"aggregate(sequence({first}, {first + n - 1}), 0L, (s, i) -> s + IF(embedding[i] > 0, shiftleft(1L, i - {first} + {shift}), 0L))"


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{sign_bits(0, 63)} AS base", f"{sign_bits(0, 16)} AS top", "explode(sequence(0, 3)) AS k")
    return rows.selectExpr(
        "CAST(NULL AS STRING) AS scope", "vec_id * 4 + k AS ord", "md5(concat(vec_id, '-', IF(k = 3, 0, k))) AS md5",
        "CASE k WHEN 1 THEN base ^ shiftleft(1L, CAST(vec_id % 62 AS INT)) WHEN 2 THEN base ^ (shiftleft(1L, CAST(vec_id % 16 AS INT)) - 1) ELSE base END AS h",
        "CASE k WHEN 2 THEN top ^ (shiftleft(1L, CAST(vec_id % 11 AS INT)) - 1) ELSE top END AS tp",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, x -> CAST(x AS DOUBLE)) AS e", "explode(sequence(0, 1)) AS k")
    return rows.selectExpr("vec_id * 2 + k AS ord", "transform(e, (x, i) -> x + k * (0.02D + 0.02D * (vec_id % 40)) * e[size(e) - 1 - i]) AS v")


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{sign_bits(0, 63)} AS base", "explode(sequence(0, 1)) AS k")
    return rows.selectExpr("(vec_id div 10) * 2 + k AS video", "vec_id % 10 AS frame_idx", "IF(k = 1 AND vec_id % 10 < (vec_id div 10) % 10, base ^ (shiftleft(1L, 40) - 1), base) AS h")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("user_id AS video", "event_id AS frame_no", "CASE user_id % 3 WHEN 0 THEN 24.0D WHEN 1 THEN 25.0D ELSE 0.3D END AS fps")


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [f"{sign_bits(16 * q, 16)} AS w{q}" for q in range(4)]
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", *words, "explode(sequence(0, 1)) AS k")
    return rows.selectExpr("(vec_id div 8) * 2 + k AS file", "vec_id % 8 AS kp", "IF(k = 1, w0 ^ shiftleft(1L, CAST(vec_id % 16 AS INT)), w0) AS w0", "w1", "w2", "w3")


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter("ord % 3 <> 0").selectExpr("path", "length", "IF(ord % 7 = 0, mtime + INTERVAL 1 DAY, mtime) AS mtime", "md5", "IF(ord % 10 = 0, '', substr(md5, 1, 16)) AS phash_top", "CAST(ord AS DOUBLE) AS computed_at")


def scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    previous = orders.filter("o_orderkey % 10 <> 0").selectExpr("CAST(o_orderkey AS STRING) AS path", "CAST(o_totalprice AS DOUBLE) AS length", "o_orderdate AS mtime")
    current = orders.filter("o_orderkey % 7 <> 0").selectExpr("CAST(o_orderkey AS STRING) AS path", "CAST(o_totalprice AS DOUBLE) + IF(o_orderkey % 11 = 0, 1, 0) AS length", "o_orderdate AS mtime")
    return previous, current


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS scan_id", "concat('[\"', o_orderpriority, '\"]') AS source_key", "CAST(o_orderdate AS TIMESTAMP) AS started_at", "IF(o_orderkey % 5 = 0, NULL, CAST(o_orderdate AS TIMESTAMP)) AS finished_at")


_SUFFIX = "CASE {0} % 7 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' WHEN 2 THEN 'zip' WHEN 3 THEN 'tar.gz' WHEN 4 THEN 'xlsx' WHEN 5 THEN 'txt' ELSE 'mp4' END"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(f"concat('/data/', source, '/', lang, '/', doc_id, '.', {_SUFFIX.format('doc_id')}) AS path", "TIMESTAMP'2024-03-01' + make_dt_interval(CAST(doc_id % 3 AS INT)) AS mtime", "n_chars AS length")
    pages = table(spark, sf_dir, "pages").selectExpr(f"concat('/data/pages/', page_id, '.', {_SUFFIX.format('page_id')}) AS path", "TIMESTAMP'2024-03-01' + make_dt_interval(CAST(page_id % 3 AS INT)) AS mtime", "length(html) AS length")
    return docs.unionByName(pages.withColumn("length", F.col("length").cast("long")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_brand AS archive", "p_partkey AS member_ord", "CAST(p_size AS BIGINT) * 1000 AS size")


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.selectExpr("p_partkey AS ord", "IF(p_partkey % 5 = 0, map('type', p_type, 'size', CAST(p_size AS STRING)), map('brand', p_brand, 'type', p_type, 'size', CAST(p_size AS STRING))) AS a")
    b = part.selectExpr("p_partkey - 1 AS ord", "IF(p_partkey % 5 = 0, map('type', p_type, 'size', CAST(p_size AS STRING)), map('brand', p_brand, 'type', p_type, 'size', CAST(p_size AS STRING))) AS b")
    return a.join(b, "ord")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS path", "transform(embedding, x -> CAST(floor((greatest(-1D, least(1D, CAST(x AS DOUBLE) * 2D)) + 1D) / 2D * 255D) AS INT)) AS px")


def _bits(first: int, n: int) -> str:
    return f"CAST(list_sum(list_transform(range(0, {n}), lambda i: CASE WHEN embedding[i + {first + 1}] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE CAST(0 AS BIGINT) END)) AS BIGINT)"


#: The fixtures as SQL common table expressions.
SQL = {
    "files": "SELECT doc_id AS ord, source || '/' || doc_id || '/' || (n_chars % 97) || '.txt' AS path, source AS scope, md5(text) AS md5, n_chars AS length, n_chars % 97 + 1 AS width, doc_id % 13 + 1 AS height, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS mtime FROM documents",
    "base": f"SELECT vec_id, {_bits(0, 63)} AS base, {_bits(0, 16)} AS top FROM embeddings",
    "hashes": """SELECT vec_id * 4 + k AS ord, md5(vec_id || '-' || (CASE WHEN k = 3 THEN 0 ELSE k END)) AS md5,
        CASE k WHEN 1 THEN xor(base, CAST(1 AS BIGINT) << CAST(vec_id % 62 AS INTEGER)) WHEN 2 THEN xor(base, (CAST(1 AS BIGINT) << CAST(vec_id % 16 AS INTEGER)) - 1) ELSE base END AS h,
        CASE k WHEN 2 THEN xor(top, (CAST(1 AS BIGINT) << CAST(vec_id % 11 AS INTEGER)) - 1) ELSE top END AS tp FROM base, (SELECT unnest([0, 1, 2, 3]) AS k)""",
    "vectors": "SELECT vec_id * 2 + k AS ord, list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) + k * (0.02::DOUBLE + 0.02::DOUBLE * (vec_id % 40)) * CAST(embedding[len(embedding) + 1 - i] AS DOUBLE)) AS v FROM embeddings, (SELECT unnest([0, 1]) AS k)",
    "keyframes": "SELECT (vec_id // 10) * 2 + k AS video, vec_id % 10 AS frame_idx, CASE WHEN k = 1 AND vec_id % 10 < (vec_id // 10) % 10 THEN xor(base, (CAST(1 AS BIGINT) << 40) - 1) ELSE base END AS h FROM base, (SELECT unnest([0, 1]) AS k)",
    "frames": "SELECT user_id AS video, event_id AS frame_no, CASE user_id % 3 WHEN 0 THEN 24.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE ELSE 0.3::DOUBLE END AS fps FROM events",
    "words": f"SELECT vec_id, {', '.join(f'{_bits(16 * q, 16)} AS w{q}' for q in range(4))} FROM embeddings",
    "descriptors": "SELECT (vec_id // 8) * 2 + k AS file, vec_id % 8 AS kp, CASE WHEN k = 1 THEN xor(w0, CAST(1 AS BIGINT) << CAST(vec_id % 16 AS INTEGER)) ELSE w0 END AS w0, w1, w2, w3 FROM words, (SELECT unnest([0, 1]) AS k)",
    "cached": "SELECT path, length, CASE WHEN ord % 7 = 0 THEN mtime + INTERVAL 1 DAY ELSE mtime END AS mtime, md5, CASE WHEN ord % 10 = 0 THEN '' ELSE substr(md5, 1, 16) END AS phash_top, CAST(ord AS DOUBLE) AS computed_at FROM files WHERE ord % 3 <> 0",
    "previous": "SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_totalprice AS DOUBLE) AS length, o_orderdate AS mtime FROM orders WHERE o_orderkey % 10 <> 0",
    "current_scan": "SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_totalprice AS DOUBLE) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS length, o_orderdate AS mtime FROM orders WHERE o_orderkey % 7 <> 0",
    "history": "SELECT o_orderkey AS scan_id, '[\"' || o_orderpriority || '\"]' AS source_key, CAST(o_orderdate AS TIMESTAMP) AS started_at, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS finished_at FROM orders",
    "tree": f"SELECT '/data/' || source || '/' || lang || '/' || doc_id || '.' || {_SUFFIX.format('doc_id')} AS path, TIMESTAMP '2024-03-01' + to_days(CAST(doc_id % 3 AS INTEGER)) AS mtime, n_chars AS length FROM documents UNION ALL SELECT '/data/pages/' || page_id || '.' || {_SUFFIX.format('page_id')}, TIMESTAMP '2024-03-01' + to_days(CAST(page_id % 3 AS INTEGER)), length(html) FROM pages",
    "kinds": "SELECT *, CASE suffix WHEN 'jpg' THEN 'image' WHEN 'png' THEN 'image' WHEN 'zip' THEN 'archive' WHEN 'tar.gz' THEN 'archive' WHEN 'xlsx' THEN 'document' WHEN 'mp4' THEN 'video' ELSE 'other' END AS kind FROM (SELECT *, lower(regexp_extract(path, '[0-9]+\\.(.*)$', 1)) AS suffix, regexp_replace(path, '/[^/]*$', '') AS dir FROM tree)",
    "members": "SELECT p_brand AS archive, p_partkey AS member_ord, CAST(p_size AS BIGINT) * 1000 AS size FROM part",
    "tiles": "SELECT vec_id AS path, list_transform(embedding, lambda x: CAST(floor((greatest(-1::DOUBLE, least(1::DOUBLE, CAST(x AS DOUBLE) * 2)) + 1) / 2 * 255) AS INTEGER)) AS px FROM embeddings",
    # Built on those above.
    "exact": "SELECT scope, md5, count(*) AS n_files, min(ord) AS first_ord FROM files GROUP BY ALL HAVING count(*) >= 2",
    "pool": "SELECT md5, count(*) AS n_files, min(ord) AS first_ord, row_number() OVER (ORDER BY min(ord)) AS group_id FROM files GROUP BY md5 HAVING count(*) >= 2",
    "own": "SELECT f.*, p.group_id, p.first_ord, p.n_files FROM files f JOIN pool p USING (md5)",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY width * height DESC, length DESC, mtime DESC, ord) AS rank, row_number() OVER (PARTITION BY group_id ORDER BY width * height DESC, length DESC, ord) AS rank2 FROM own",
    "edges": "SELECT x.ord AS a, y.ord AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS dist, CAST(bit_count(xor(x.tp, y.tp)) AS INTEGER) AS dist_top FROM hashes x JOIN hashes y ON x.ord < y.ord AND x.md5 <> y.md5 AND bit_count(xor(x.h, y.h)) <= 10",
    "linked": "SELECT a, b FROM edges UNION SELECT b, a FROM edges",
    "reach": "SELECT a AS ord, a AS m FROM linked UNION SELECT l.b, r.m FROM reach r JOIN linked l ON l.a = r.ord",
    "comp": "SELECT ord, min(m) AS first_ord FROM reach GROUP BY ord",
    "pairs": "SELECT x.first_ord, bit_count(xor(p.h, q.h)) AS full_d, bit_count(xor(p.tp, q.tp)) AS top_d, coalesce(0.8 * e.dist + 0.2 * e.dist_top, 0) AS blended FROM comp x JOIN comp y ON x.first_ord = y.first_ord AND x.ord < y.ord JOIN hashes p ON p.ord = x.ord JOIN hashes q ON q.ord = y.ord LEFT JOIN edges e ON e.a = x.ord AND e.b = y.ord",
    "perceptual": "SELECT first_ord, (SELECT count(*) FROM comp c WHERE c.first_ord = pairs.first_ord) AS n_files, avg(full_d) AS avg_full, avg(top_d) AS avg_top, round(greatest(0.0, 1 - avg(CAST(blended AS DOUBLE)) / 64), 3) AS similarity, avg(top_d) >= 2.0 AND avg(top_d) > avg(full_d) * 1.5 AS multi_account FROM pairs GROUP BY first_ord",
    "groups": "SELECT *, row_number() OVER (ORDER BY place, first_ord) AS group_id FROM (SELECT 0 AS place, 'exact' AS method, first_ord, n_files, CAST(1.0 AS DOUBLE) AS similarity, false AS multi_account FROM pool UNION ALL SELECT 1, 'perceptual', first_ord, n_files, similarity, multi_account FROM perceptual)",
    "near_vectors": "SELECT x.ord AS a, y.ord AS b, list_cosine_similarity(x.v, y.v) AS cosine FROM vectors x JOIN vectors y ON x.ord < y.ord AND list_cosine_similarity(x.v, y.v) >= 0.85",
    "near_videos": "SELECT a, b, met * 1.0::DOUBLE / n AS share FROM (SELECT x.video AS a, y.video AS b, count(DISTINCT x.frame_idx) AS met FROM keyframes x JOIN keyframes y ON x.video < y.video AND bit_count(xor(x.h, y.h)) <= 10 GROUP BY ALL) JOIN (SELECT video AS a, count(DISTINCT frame_idx) AS n FROM keyframes GROUP BY 1) USING (a) WHERE met * 1.0 / n > 0.5",
}


def sql(text: str, *names: str, recursive: bool = False, **other: str) -> str:
    """A query over the named fixtures (in the order of their dependence); ``other`` replaces some."""
    parts = SQL | other
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(f"{n} AS ({parts[n]})" for n in names) + " " + text
