"""The registered queries of the library, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.functions import scalars as S
from kindred.operators import forensics as X, groups as G, images as I, similarity as J, survivors as V
from kindred.plans import fixtures as T, report as R
from kindred.plans.fixtures import sql
from kindred.plans.scan import perceptual, scan_archives
from kindred.plans.storage import fresh_path, materialise
from kindred.sources import archives as A, files as M, store as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _pool(spark: SparkSession, d: str) -> DataFrame:
    return T.files(spark, d).withColumn("scope", F.lit(None).cast("string"))


def _own(spark: SparkSession, d: str) -> DataFrame:
    """Members of the exact groups of all files, with the group's number and the files' columns."""
    files = _pool(spark, d)
    groups = G.number_groups(G.exact_groups(files), F.asc("first_ord"))
    return files.join(groups.select("md5", "group_id", "first_ord", "n_files"), "md5")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    found, _ = perceptual(T.hashes(spark, d))
    return G.all_groups(("exact", G.exact_groups(_pool(spark, d))), ("perceptual", found))


_GROUPS = ("base", "hashes", "files", "pool", "edges", "linked", "reach", "comp", "pairs", "perceptual", "groups")
_OWN = ("files", "pool", "own", "ranked")


@query(sql("SELECT md5, n_files, first_ord, group_id FROM pool", "files", "pool"))
def exact_groups(spark, d):
    return G.number_groups(G.exact_groups(_pool(spark, d)), F.asc("first_ord")).select("md5", "n_files", "first_ord", "group_id")


@query(sql("SELECT ord, md5, first_ord, n_files FROM own", "files", "pool", "own"))
def exact_members(spark, d):
    return G.exact_members(_pool(spark, d)).select("ord", "md5", "first_ord", "n_files")


@query(sql("SELECT scope, md5, n_files, first_ord FROM exact", "files", "exact"))
def scoped_exact_groups(spark, d):
    files = G.comparable(G.assign_scope(T.files(spark, d).withColumnRenamed("scope", "source_group")))
    return G.exact_groups(files).select("scope", "md5", "n_files", "first_ord")


@query(sql("SELECT md5, n_files, first_ord FROM pool", "files", "pool"))
def cross_scope_groups(spark, d):
    files = G.assign_scope(T.files(spark, d).withColumnRenamed("scope", "source_group"), cross_doc=True)
    return G.exact_groups(files).select("md5", "n_files", "first_ord")


def _edges_sql(t: int) -> str:
    return sql(f"SELECT x.ord AS a, y.ord AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS dist FROM hashes x JOIN hashes y ON x.ord < y.ord AND x.md5 <> y.md5 AND bit_count(xor(x.h, y.h)) <= {t}", "base", "hashes")


@query(_edges_sql(10))
def hamming_edges_t10(spark, d):
    return J.hamming_edges(T.hashes(spark, d), 10)


@query(_edges_sql(3))
def hamming_edges_t3(spark, d):
    return J.hamming_edges(T.hashes(spark, d), 3)


@query(_edges_sql(20))
def hamming_edges_t20(spark, d):
    return J.hamming_edges(T.hashes(spark, d), 20)


@query(sql("SELECT ord, first_ord FROM comp", "base", "hashes", "edges", "linked", "reach", "comp", recursive=True))
def perceptual_components(spark, d):
    return G.components_of(J.hamming_edges(T.hashes(spark, d), 10))


@query(sql("SELECT first_ord, n_files, round(avg_full, 6) AS avg_full, round(avg_top, 6) AS avg_top, similarity FROM perceptual", "base", "hashes", "edges", "linked", "reach", "comp", "pairs", "perceptual", recursive=True))
def perceptual_group_stats(spark, d):
    found, _ = perceptual(T.hashes(spark, d))
    return found.select("first_ord", "n_files", F.round("avg_full", 6).alias("avg_full"), F.round("avg_top", 6).alias("avg_top"), "similarity")


@query(sql("SELECT first_ord, multi_account FROM perceptual", "base", "hashes", "edges", "linked", "reach", "comp", "pairs", "perceptual", recursive=True))
def multi_account_flag(spark, d):
    return perceptual(T.hashes(spark, d))[0].select("first_ord", "multi_account")


_ARCHIVED = "SELECT * REPLACE ('z' || (ord // 4 % 5) AS scope) FROM (SELECT CAST(NULL AS VARCHAR) AS scope, * FROM hashes)"
_ARCHIVE_EDGES = "SELECT x.ord AS a, y.ord AS b, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS dist, CAST(bit_count(xor(x.tp, y.tp)) AS INTEGER) AS dist_top FROM hashes x JOIN hashes y ON x.ord < y.ord AND x.ord // 4 % 5 = y.ord // 4 % 5 AND x.md5 <> y.md5 AND bit_count(xor(x.h, y.h)) <= 10"
_ARCHIVE_GROUPS = f"""SELECT archive, method, first_ord, n_files, similarity, row_number() OVER (ORDER BY archive, place, first_ord) AS group_id FROM (
    SELECT scope AS archive, 0 AS place, 'exact' AS method, min(ord) AS first_ord, count(*) AS n_files, 1.0::DOUBLE AS similarity FROM ({_ARCHIVED}) GROUP BY scope, md5 HAVING count(*) >= 2
    UNION ALL SELECT 'z' || (first_ord // 4 % 5), 1, 'perceptual', first_ord, n_files, similarity FROM perceptual)"""


@query(sql(_ARCHIVE_GROUPS, "base", "hashes", "edges", "linked", "reach", "comp", "pairs", "perceptual", recursive=True, edges=_ARCHIVE_EDGES))
def all_archive_scan(spark, d):
    """Exact and perceptual groups of five archives at once."""
    hashes = T.hashes(spark, d).withColumn("scope", F.concat(F.lit("z"), F.expr("ord div 4 % 5").cast("string")))
    return scan_archives(hashes).select("archive", "method", "first_ord", "n_files", "similarity", "group_id")


@query(sql("SELECT path, CASE WHEN m THEN 1.0::DOUBLE * length / fps ELSE 0.0::DOUBLE END AS duration, CASE WHEN m THEN CAST(floor(length / (fps * 2.0::DOUBLE)) AS BIGINT) ELSE 0 END AS keyframes FROM (SELECT path, length, length % 2 = 0 AS m, CASE length % 3 WHEN 0 THEN 24.0::DOUBLE ELSE 25.0::DOUBLE END AS fps FROM kinds WHERE kind = 'video')", "tree", "kinds"))
def video_list(spark, d):
    """Videos of a folder with what is known of half of them."""
    tree = T.tree(spark, d)
    meta = tree.filter("length % 2 = 0").select("path", F.col("length").alias("frames"), F.expr("IF(length % 3 = 0, 24.0D, 25.0D)").alias("fps"))
    return M.video_manifest(tree, meta).select("path", "duration", F.col("keyframe_count").alias("keyframes"))


@query(sql("SELECT 7 AS scan_id, '[\"a\",\"b\"]' AS source_key, TIMESTAMP '2024-01-02 03:00:00' AS finished_at, CAST(sum(n_files) AS BIGINT) AS total_files, count(*) AS total_groups FROM pool UNION ALL SELECT 8, '[\"c\"]', NULL, NULL, NULL", "files", "pool"))
def session_log(spark, d):
    """A session opened and closed with its totals, and one that is still open."""
    at = dt.datetime(2024, 1, 2, tzinfo=dt.timezone.utc)
    both = C.open_session(spark, 7, ["a", "b"], at).unionByName(C.open_session(spark, 8, ["c"], at))
    closed = C.close_session(both, 7, G.exact_groups(_pool(spark, d)), dt.datetime(2024, 1, 2, 3, tzinfo=dt.timezone.utc))
    return closed.select(F.col("scan_id").cast("int").alias("scan_id"), "source_key", "finished_at", "total_files", "total_groups")


@query(sql("SELECT a, b, round(cosine, 6) AS cosine FROM near_vectors", "vectors", "near_vectors"))
def cosine_edges(spark, d):
    return J.cosine_edges(T.vectors(spark, d)).withColumn("cosine", F.round("cosine", 6))


_SEMANTIC = """SELECT first_ord, (SELECT count(*) FROM comp c WHERE c.first_ord = g.first_ord) AS n_files, round(avg(c), 6) AS similarity FROM (
    SELECT x.first_ord, list_cosine_similarity(p.v, q.v) AS c FROM comp x JOIN comp y ON x.first_ord = y.first_ord AND x.ord < y.ord JOIN vectors p ON p.ord = x.ord JOIN vectors q ON q.ord = y.ord) g GROUP BY first_ord"""


@query(sql(_SEMANTIC, "vectors", "near_vectors", "edges", "linked", "reach", "comp", recursive=True, edges="SELECT a, b FROM near_vectors"))
def semantic_groups(spark, d):
    vectors = T.vectors(spark, d)
    members = materialise(G.components_of(J.cosine_edges(vectors)), "members")
    found = G.semantic_groups(vectors.select("ord", S.l2_normalise(F.col("v")).alias("unit")), members)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(sql("SELECT a, b, share FROM near_videos", "base", "keyframes", "near_videos"))
def video_edges(spark, d):
    return J.video_edges(T.keyframes(spark, d))


@query(sql("SELECT first_ord, count(*) AS n_files, 1.0::DOUBLE AS similarity FROM comp GROUP BY first_ord", "base", "keyframes", "near_videos", "edges", "linked", "reach", "comp", recursive=True, edges="SELECT a, b FROM near_videos"))
def video_groups(spark, d):
    return G.video_groups(G.components_of(J.video_edges(T.keyframes(spark, d))))


_MATCH = """SELECT a, b, kp_a, kp_b, good, CASE WHEN least(kp_a, kp_b) < 2 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, good * 1.0::DOUBLE / least(kp_a, kp_b)), 3) END AS score FROM (
    SELECT a, b, (SELECT count(*) FROM descriptors WHERE file = a) AS kp_a, (SELECT count(*) FROM descriptors WHERE file = b) AS kp_b, CAST(sum(CASE WHEN k = 2 AND d1 < 0.75 * d2 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM (
      SELECT a, b, ka, min(d) AS d1, max(d) AS d2, count(*) AS k FROM (
        SELECT x.file AS a, y.file AS b, x.kp AS ka, bit_count(xor(x.w0, y.w0)) + bit_count(xor(x.w1, y.w1)) + bit_count(xor(x.w2, y.w2)) + bit_count(xor(x.w3, y.w3)) AS d,
          row_number() OVER (PARTITION BY x.file, y.file, x.kp ORDER BY bit_count(xor(x.w0, y.w0)) + bit_count(xor(x.w1, y.w1)) + bit_count(xor(x.w2, y.w2)) + bit_count(xor(x.w3, y.w3)), y.kp) AS r
        FROM descriptors x JOIN descriptors y ON x.file < y.file) WHERE r <= 2 GROUP BY a, b, ka) GROUP BY a, b) WHERE good > 0"""


@query(sql(_MATCH, "words", "descriptors"))
def descriptor_matches(spark, d):
    """All pairs of files that have a good match."""
    return J.descriptor_scores(T.descriptors(spark, d))


@query(sql("SELECT c.first_ord, count(DISTINCT c.ord) AS n_files, round(avg(e.score), 3) AS similarity FROM comp c JOIN (SELECT a, b, score FROM edges) e ON e.a = c.ord OR e.b = c.ord GROUP BY 1", "words", "descriptors", "edges", "linked", "reach", "comp", recursive=True, edges=f"SELECT * FROM ({_MATCH}) WHERE score >= 0.15"))
def feature_groups(spark, d):
    edges = materialise(J.feature_links(T.descriptors(spark, d)), "features")
    return G.feature_groups(edges, G.components_of(edges))


@query(sql("SELECT video, frame_no FROM frames WHERE floor(fps * 2.0) >= 1 AND frame_no % CAST(floor(fps * 2.0) AS BIGINT) = 0", "frames"))
def keyframe_sampling(spark, d):
    return J.sample_keyframes(T.frames(spark, d)).select("video", "frame_no")


@query(sql("SELECT video, frame_no, 1.0::DOUBLE * frame_no / fps AS duration, CAST(floor(frame_no / (fps * 2.0)) AS BIGINT) AS keyframes FROM frames", "frames"))
def video_durations(spark, d):
    return T.frames(spark, d).select("video", "frame_no", S.duration_seconds(F.col("frame_no"), F.col("fps")).alias("duration"), S.keyframe_count(F.col("frame_no"), F.col("fps")).alias("keyframes"))


@query("SELECT video, string_agg(right(repeat('0', 16) || lower(hex(h)), 16), ',' ORDER BY frame_idx) AS hashes FROM (" + sql("SELECT video, frame_idx, h FROM keyframes", "base", "keyframes") + ") GROUP BY video")
def video_hash_lists(spark, d):
    lists = J.video_hashes(T.keyframes(spark, d))
    return lists.select("video", F.array_join(F.transform("hashes", lambda h: S.long_to_hex(h)), ",").alias("hashes"))


@query(sql("SELECT ord, pos - 1 AS i, round(v[pos] / sqrt(list_dot_product(v, v)), 9) AS x FROM vectors, (SELECT unnest(range(1, 65)) AS pos)", "vectors"))
def l2_normalise(spark, d):
    return T.vectors(spark, d).select("ord", F.posexplode(S.l2_normalise(F.col("v"))).alias("i", "x")).select("ord", F.col("i").cast("long").alias("i"), F.round("x", 9).alias("x"))


@query(sql("SELECT group_id, ord, path FROM ranked WHERE rank = 1", *_OWN))
def keep_best(spark, d):
    return V.keep_best(_own(spark, d)).select("group_id", "ord", "path")


@query(sql("SELECT group_id, ord, path FROM ranked WHERE rank2 = 1", *_OWN))
def keep_best_no_mtime(spark, d):
    return V.keep_best(_own(spark, d), use_mtime=False).select("group_id", "ord", "path")


@query(sql("SELECT group_id, ord, path FROM ranked WHERE rank > 1", *_OWN))
def select_duplicates(spark, d):
    return V.duplicates(_own(spark, d)).select("group_id", "ord", "path")


@query(sql("SELECT group_id, count(*) AS n_delete, CAST(sum(length) AS BIGINT) AS bytes_reclaimed FROM ranked WHERE rank > 1 GROUP BY group_id", *_OWN))
def delete_plan(spark, d):
    return V.delete_plan(_own(spark, d))


@query(sql("SELECT ord, path, '/moved/' || CASE WHEN n = 1 THEN name ELSE replace(name, '.txt', '_' || (n - 1) || '.txt') END AS target FROM (SELECT ord, path, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*$') ORDER BY ord) AS n FROM ranked WHERE rank > 1)", *_OWN))
def move_plan(spark, d):
    return V.move_plan(_own(spark, d), "/moved")


@query(sql("SELECT group_id, ord, path, regexp_replace(path, '[^/]*$', '') || 'copy' || group_id || '_' || printf('%03d', row_number() OVER (PARTITION BY group_id ORDER BY ord)) || '.txt' AS target FROM own", "files", "pool", "own"))
def rename_plan(spark, d):
    return V.rename_plan(_own(spark, d), "copy")


@query(sql("SELECT group_id, ord, path, regexp_replace(path, '[^/]*$', '') || 'copy' || group_id || '_' || printf('%03d', row_number() OVER (PARTITION BY group_id ORDER BY ord)) || CASE WHEN ord % 2 = 0 THEN '_1' ELSE '' END || '.txt' AS target FROM own", "files", "pool", "own"))
def rename_collisions(spark, d):
    """Half of the names are taken already, and listed twice."""
    own = _own(spark, d)
    taken = V.rename_plan(own, "copy").filter("ord % 2 = 0").select(S.parent(F.col("target")).alias("dir"), S.file_name(F.col("target")).alias("name"))
    return V.rename_plan(own, "copy", existing=taken.unionByName(taken))


_FREE = "SELECT k, row_number() OVER (ORDER BY k) AS j FROM (SELECT unnest(range(1, 1001 + (SELECT count(*) FROM own))) AS k) WHERE k > 1000 OR k % 3 <> 1"


@query(sql(f"SELECT ord, path, '/moved/' || replace(name, '.txt', '_' || k || '.txt') AS target FROM (SELECT ord, path, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY regexp_extract(path, '[^/]*$') ORDER BY ord) AS j FROM ranked WHERE rank > 1) JOIN ({_FREE}) USING (j)", *_OWN))
def move_collisions(spark, d):
    """Every name is taken there, and a third of its numbers up to a thousand."""
    own = _own(spark, d)
    names = V.duplicates(own).select(S.file_name(F.col("path")).alias("name")).distinct()
    numbers = F.filter(F.sequence(F.lit(1), F.lit(1000)), lambda k: k % 3 == 1)
    numbered = names.select(F.explode(F.transform(numbers, lambda k: F.concat(F.regexp_replace("name", r"\.txt$", "_"), k.cast("string"), F.lit(".txt")))).alias("name"))
    return V.move_plan(own, "/moved", existing=names.unionByName(numbered).withColumn("dir", F.lit("/moved")))


@query(sql("SELECT group_id, ord, rank FROM ranked", *_OWN))
def ranked_members(spark, d):
    return V.ranked(_own(spark, d)).select("group_id", "ord", "rank")


@query(sql("SELECT group_id, ord, regexp_replace(path, '[^/]*$', '') || 'copy' || group_id || '_' || printf('%03d', row_number() OVER (PARTITION BY group_id ORDER BY ord)) || '.txt' AS path FROM own", "files", "pool", "own"))
def renamed_members(spark, d):
    own = _own(spark, d)
    return V.apply_renames(own, V.rename_plan(own, "copy")).select("group_id", "ord", "path")


@query(sql("SELECT path FROM own ORDER BY ord LIMIT 10", "files", "pool", "own"))
def preview_rows(spark, d):
    return V.preview(_own(spark, d), 10)[0]


@query(sql("SELECT x.first_ord, x.ord AS a, y.ord AS b FROM own x JOIN own y ON x.group_id = y.group_id AND x.ord < y.ord", "files", "pool", "own"))
def group_pairs(spark, d):
    return G.pairs_in_groups(G.exact_members(_pool(spark, d)).select("first_ord", "ord"))


@query(sql("SELECT 'hash' AS stage, error_type, count(*) AS n FROM (SELECT CASE WHEN length = 0 THEN 'EmptyFile' WHEN length > 3000 THEN 'FileTooLarge' END AS error_type FROM (SELECT CASE WHEN ord % 50 = 7 THEN 0 ELSE length END AS length FROM files)) WHERE error_type IS NOT NULL GROUP BY ALL", "files"))
def error_counts(spark, d):
    files = T.files(spark, d).withColumn("length", F.expr("IF(ord % 50 = 7, 0, length)"))
    return R.error_counts(C.split_errors(M.size_guards(files, most=3000))[1])


@query(sql("SELECT ord, 'length ' || length AS message FROM (SELECT ord, CASE WHEN ord % 50 = 7 THEN 0 ELSE length END AS length FROM files) WHERE length = 0 OR length > 3000", "files"))
def guarded_files(spark, d):
    files = T.files(spark, d).withColumn("length", F.expr("IF(ord % 50 = 7, 0, length)"))
    return M.size_guards(files, most=3000).filter("error_type is not null").select("ord", F.col("error_message").alias("message"))


@query("SELECT doc_id AS ord, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_digests(spark, d):
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), *S.content_digests(F.col("text").cast("binary")))


@query("SELECT doc_id AS ord, left(text, 200) AS text, CAST(DATE '1970-01-01' + CAST(doc_id AS INTEGER) AS VARCHAR) AS day FROM documents")
def short_texts(spark, d):
    """Texts cut for display, and dates of epoch seconds."""
    day = S.date_of_epoch(F.col("doc_id") * 86400 + 3600).cast("string")
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("ord"), S.truncate_text(F.col("text")).alias("text"), day.alias("day"))


@query(sql("SELECT ord, right(repeat('0', 16) || lower(hex(h)), 16) AS hex, h FROM hashes", "base", "hashes"))
def parsed_hashes(spark, d):
    return T.hashes(spark, d).select("ord", S.long_to_hex(F.col("h")).alias("hex")).withColumn("h", S.hex_to_long(F.col("hex")))


@query(sql("SELECT 2 AS scan_id, path, length FROM files UNION ALL SELECT 1, path, length FROM files WHERE ord % 3 = 0", "files"))
def session_files(spark, d):
    """Two sessions' files, the second recorded twice."""
    files = T.files(spark, d)
    first = C.record_files(files.limit(0).selectExpr("0L AS scan_id", "path", "length", "mtime"), 1, files.filter("ord % 3 = 0"))
    twice = C.record_files(C.record_files(first, 2, files.filter("ord % 2 = 0")), 2, files)
    return twice.select(F.col("scan_id").cast("int").alias("scan_id"), "path", "length")


@query(sql("SELECT regexp_extract(path, '^/data/[^/]*') AS path, CAST(sum(CASE WHEN kind = 'image' THEN 1 ELSE 0 END) AS BIGINT) AS n_images FROM kinds GROUP BY 1", "tree", "kinds"))
def earlier_folders(spark, d):
    return C.earlier_folders(T.tree(spark, d), "/data")


@query(sql("SELECT archive, group_id, string_agg(path, ',' ORDER BY ord) AS files FROM (SELECT e.scope AS archive, f.path, f.ord, dense_rank() OVER (ORDER BY e.first_ord) AS group_id FROM exact e JOIN files f ON f.scope = e.scope AND f.md5 = e.md5) GROUP BY ALL", "files", "exact"))
def archive_file_lists(spark, d):
    files = T.files(spark, d)
    groups = G.number_groups(G.exact_groups(files), F.asc("first_ord"))
    members = G.exact_members(files).join(groups.select("scope", "md5", "group_id"), ["scope", "md5"]).join(files.select("ord", "path"), "ord")
    found = R.archive_groups(groups.withColumnRenamed("scope", "archive"), members)
    return found.select("archive", "group_id", F.array_join("files", ",").alias("files"))


@query(sql("""SELECT scope AS archive_path, count(*) AS total_files, CAST(coalesce(max(g), 0) AS BIGINT) AS duplicate_groups FROM files LEFT JOIN (SELECT scope, count(*) AS g FROM exact GROUP BY 1) USING (scope) GROUP BY 1""", "files", "exact"))
def archive_log(spark, d):
    files = T.files(spark, d).withColumnRenamed("scope", "archive")
    report = R.archive_report(G.exact_groups(T.files(spark, d)).withColumnRenamed("scope", "archive"), files)
    return R.archive_log(report).select("archive_path", "total_files", "duplicate_groups")


@query(sql("SELECT group_id, ord FROM own o WHERE ord % 3 <> 0 AND (SELECT count(*) FROM own q WHERE q.group_id = o.group_id AND q.ord % 3 <> 0) >= 2", "files", "pool", "own"))
def remove_from_results(spark, d):
    own = _own(spark, d)
    return V.remove_files(own, own.filter("ord % 3 = 0")).select("group_id", "ord")


@query(sql("SELECT group_id, method, first_ord, n_files, similarity, multi_account FROM groups WHERE method = 'perceptual'", *_GROUPS, recursive=True))
def filter_method(spark, d):
    return V.with_method(_groups(spark, d), "perceptual").select("group_id", "method", "first_ord", "n_files", "similarity", "multi_account")


@query(sql("SELECT group_id, method, similarity FROM groups WHERE similarity BETWEEN 0.95 AND 0.99", *_GROUPS, recursive=True))
def filter_similarity(spark, d):
    return V.with_similarity(_groups(spark, d), 0.95, 0.99).select("group_id", "method", "similarity")


@query(sql("SELECT group_id, ord, path FROM own WHERE contains(lower(path), 'src1')", "files", "pool", "own"))
def search_members(spark, d):
    return V.search_members(_own(spark, d), "SRC1").select("group_id", "ord", "path")


@query(sql("SELECT CAST(place AS BIGINT) AS place, method, count(*) AS n_groups, CAST(sum(n_files) AS BIGINT) AS n_files FROM groups GROUP BY ALL", *_GROUPS, recursive=True))
def method_summary(spark, d):
    return R.summary(_groups(spark, d))


@query(sql("SELECT count(*) AS n_groups, CAST(sum(n_files) AS BIGINT) AS n_files FROM groups", *_GROUPS, recursive=True))
def group_totals(spark, d):
    return R.totals(_groups(spark, d))


@query(sql("""SELECT group_id, 'Exact match' AS label, '100.0%' AS similarity, regexp_extract(path, '[^/]*$') AS name, CASE WHEN length(path) > 50 THEN '...' || right(path, 47) ELSE path END AS path,
    CASE WHEN length < 1024 THEN length || '.0 B' WHEN length < 1048576 THEN printf('%.1f KB', round(length / 1024.0::DOUBLE, 1)) ELSE printf('%.1f MB', round(length / 1048576.0::DOUBLE, 1)) END AS size, width || 'x' || height AS dimensions FROM own""", "files", "pool", "own"))  # fmt: skip
def detail_report(spark, d):
    return R.details(_own(spark, d).withColumns({"method": F.lit("exact"), "multi_account": F.lit(False), "similarity": F.lit(1.0)}))


_REPORT = sql("""SELECT archive, total_files, coalesce(n_groups, 0) AS n_groups, coalesce(n_duplicates, 0) AS n_duplicates, coalesce(n_duplicates, 0) * 1.0::DOUBLE / total_files AS high_share, coalesce(n_duplicates, 0) * 1.0 / total_files > 0.05 AS alarm
    FROM (SELECT scope AS archive, count(*) AS total_files FROM files GROUP BY 1) LEFT JOIN (SELECT scope AS archive, count(*) AS n_groups, CAST(sum(n_files) AS BIGINT) AS n_duplicates FROM exact GROUP BY 1) USING (archive)""", "files", "exact")  # fmt: skip


@query(_REPORT)
def archive_alarm(spark, d):
    files = T.files(spark, d)
    return R.archive_report(G.exact_groups(files).withColumnRenamed("scope", "archive"), files.withColumnRenamed("scope", "archive"))


@query(sql("SELECT scope AS archive, CAST(sum(n_files) AS BIGINT) AS n_duplicates FROM exact GROUP BY 1", "files", "exact"))
def archive_duplicates(spark, d):
    return G.exact_groups(T.files(spark, d)).groupBy(F.col("scope").alias("archive")).agg(F.sum("n_files").alias("n_duplicates"))


@query(sql("SELECT f.ord, c.phash_top FROM files f JOIN cached c USING (path, length, mtime) WHERE c.phash_top <> ''", "files", "cached"))
def cache_hits(spark, d):
    return C.cache_lookup(T.files(spark, d).drop("md5"), T.cached(spark, d))[0].select("ord", "phash_top")


@query(sql("SELECT ord FROM files f WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.path = f.path AND c.length = f.length AND c.mtime = f.mtime AND c.phash_top <> '')", "files", "cached"))
def cache_misses(spark, d):
    return C.cache_lookup(T.files(spark, d).drop("md5"), T.cached(spark, d))[1].select("ord")


@query(sql("SELECT path, length, phash_top FROM (SELECT *, row_number() OVER (PARTITION BY path, length, mtime ORDER BY computed_at DESC, new DESC) AS r FROM (SELECT *, 0 AS new FROM cached UNION ALL SELECT path, length, mtime, md5, 'new', 500.0::DOUBLE, 1 FROM files)) WHERE r = 1", "files", "cached"))
def cache_upsert(spark, d):
    new = T.files(spark, d).select("path", "length", "mtime", "md5", F.lit("new").alias("phash_top"), F.lit(500.0).alias("computed_at"))
    return C.cache_upsert(T.cached(spark, d), new).select("path", "length", "phash_top")


_BUCKETED = "SELECT f.ord, CASE WHEN f.ord % 3 = 0 THEN 'new' ELSE c.phash_top END AS phash_top FROM files f LEFT JOIN cached c USING (path, length, mtime) WHERE f.ord % 3 = 0 OR c.phash_top <> ''"


@query(sql(_BUCKETED, "files", "cached"))
def cache_table(spark, d):
    """The cache in a bucketed table, put there in two goes, and all files looked up in it."""
    name = "kindred_cache_" + uuid.uuid4().hex
    table = C.CacheTable(spark, name, fresh_path(spark, "cache"), "path STRING, length BIGINT, mtime TIMESTAMP, md5 STRING, phash_top STRING, computed_at DOUBLE", 8, 8)
    table.upsert(T.cached(spark, d))
    table.upsert(T.files(spark, d).filter("ord % 3 = 0").select("path", "length", "mtime", "md5", F.lit("new").alias("phash_top"), F.lit(500.0).alias("computed_at")))
    return table.lookup(T.files(spark, d).drop("md5"))[0].select("ord", "phash_top")


_DELTA = "SELECT coalesce(p.path, c.path) AS path, CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' WHEN p.length = c.length AND p.mtime = c.mtime THEN 'same' ELSE 'modified' END AS status FROM previous p FULL JOIN current_scan c ON p.path = c.path"


@query(sql(_DELTA, "previous", "current_scan"))
def scan_delta(spark, d):
    return C.scan_delta(*T.scans(spark, d))


@query(sql(f"SELECT status, count(*) AS n FROM ({_DELTA}) GROUP BY status", "previous", "current_scan"))
def delta_counts(spark, d):
    return C.scan_delta(*T.scans(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(sql("SELECT scan_id, source_key FROM history WHERE source_key = '[\"1-URGENT\"]' AND finished_at IS NOT NULL ORDER BY scan_id DESC LIMIT 1", "history"))
def last_scan(spark, d):
    key = spark.range(1).select(S.source_key(F.array(F.lit("1-URGENT"))).alias("k")).first()["k"]
    return C.last_session(T.history(spark, d), key).select("scan_id", "source_key")


@query(sql("SELECT scan_id FROM history WHERE started_at >= TIMESTAMP '1996-01-01'", "history"))
def retention(spark, d):
    history = T.history(spark, d)
    return C.retain(history, history.select("scan_id"), "1996-01-01 00:00:00")[1]


@query(sql("SELECT array_to_string(parts[1:depth], '/') AS dir, depth, count(*) AS n_images, CAST(sum(CASE WHEN depth = len(parts) THEN 1 ELSE 0 END) AS BIGINT) AS n_direct FROM (SELECT string_split(dir, '/') AS parts, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth FROM kinds WHERE kind = 'image') GROUP BY ALL", "tree", "kinds"))
def dir_inventory(spark, d):
    return M.inventory(T.tree(spark, d))


@query(sql("SELECT kind, suffix AS format, count(*) AS n FROM kinds GROUP BY ALL", "tree", "kinds"))
def format_counts(spark, d):
    return M.count_kinds(T.tree(spark, d))


@query(sql("SELECT path, kind FROM kinds WHERE kind IN ('archive', 'document') AND CAST(mtime AS DATE) = DATE '2024-03-03' UNION ALL SELECT dir, 'folder' FROM kinds GROUP BY dir HAVING CAST(max(mtime) AS DATE) = DATE '2024-03-03'", "tree", "kinds"))
def new_today(spark, d):
    return M.new_on(T.tree(spark, d), F.lit("2024-03-03").cast("date"))


@query(sql("SELECT path, source_ord, row_number() OVER (ORDER BY source_ord, path) - 1 AS ord FROM (SELECT path, min(s) AS source_ord FROM (SELECT path, 0 AS s FROM kinds WHERE kind = 'image' UNION ALL SELECT path, 1 FROM kinds WHERE kind <> 'video') GROUP BY path)", "tree", "kinds"))
def source_union(spark, d):
    tree = T.tree(spark, d).withColumn("kind", S.kind(F.col("path")))
    return M.union_sources(tree.filter("kind = 'image'"), tree.filter("kind <> 'video'")).select("path", "source_ord", F.col("ord").cast("long").alias("ord"))


@query(sql("SELECT path FROM tree WHERE path LIKE '/data/src1/%' OR path LIKE '/data/src2/en/%'", "tree"))
def subtree_select(spark, d):
    checked = T.tree(spark, d).select(F.explode(F.array(F.lit("/data/src1"), F.lit("/data/src2/en"))).alias("path")).distinct()
    return M.select_subtrees(T.tree(spark, d), checked).select("path")


@query(sql("SELECT path FROM kinds WHERE kind = 'archive' AND mtime < TIMESTAMP '2024-03-03'", "tree", "kinds"))
def pending_queue(spark, d):
    archives = T.tree(spark, d).filter(S.kind(F.col("path")) == "archive")
    queue = archives.select("path").unionByName(archives.select("path"))
    return C.pending(queue, archives.filter("mtime >= TIMESTAMP'2024-03-03'")).select("path")


@query(sql("SELECT archive, member_ord, CAST(total AS BIGINT) AS total FROM (SELECT archive, member_ord, sum(size) OVER (PARTITION BY archive ORDER BY member_ord) AS total FROM members WHERE size <= 45000) WHERE total <= 800000", "members"))
def extraction_budget(spark, d):
    return A.within_budget(T.members(spark, d), 45_000, 800_000).select("archive", "member_ord", "total")


@query("""SELECT p.p_partkey AS ord, array_to_string(list_filter(['brand', 'size', 'type'], lambda k: CASE k
    WHEN 'brand' THEN (CASE WHEN p.p_partkey % 5 = 0 THEN NULL ELSE p.p_brand END) IS DISTINCT FROM (CASE WHEN q.p_partkey % 5 = 0 THEN NULL ELSE q.p_brand END)
    WHEN 'size' THEN p.p_size <> q.p_size ELSE p.p_type <> q.p_type END), ',') AS differing FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1""")  # fmt: skip
def metadata_diff(spark, d):
    return T.metadata(spark, d).select("ord", F.array_join(X.metadata_diff(F.col("a"), F.col("b")), ",").alias("differing"))


@query(sql("SELECT path, bin, count(*) / 64.0::DOUBLE AS share FROM (SELECT path, unnest(px) AS bin FROM tiles) GROUP BY ALL", "tiles"))
def tile_histogram(spark, d):
    return X.histogram(T.tiles(spark, d).select("path", F.explode("px").alias("level")), "path", "level")


def _tile_pairs(spark, d) -> DataFrame:
    t = T.tiles(spark, d)
    return t.select(F.col("path").alias("a"), F.col("px").alias("pa")).join(t.select((F.col("path") - 1).alias("a"), F.col("px").alias("pb")), "a")


@query(sql("""SELECT a, CASE WHEN saa * sbb > 0 THEN round(sab / sqrt(saa * sbb), 4) ELSE 0.0 END AS correlation FROM (
    SELECT a, sum((x - 0.25) * (y - 0.25))::DOUBLE AS sab, sum((x - 0.25) * (x - 0.25))::DOUBLE AS saa, sum((y - 0.25) * (y - 0.25))::DOUBLE AS sbb FROM (
      SELECT t.path AS a, len(list_filter(t.px, lambda p: p = b)) AS x, len(list_filter(u.px, lambda p: p = b)) AS y FROM tiles t JOIN tiles u ON u.path = t.path + 1, (SELECT unnest(range(0, 256)) AS b)) GROUP BY a)""", "tiles"))  # fmt: skip
def histogram_correlation(spark, d):
    return _tile_pairs(spark, d).select("a", X.correlation(X.histogram_array(F.col("pa")), X.histogram_array(F.col("pb"))).alias("correlation"))


@query()
def tile_pair_figures(spark, d):
    images = T.tiles(spark, d).select("path", *I.grey_tile(F.col("px"), 8))
    pairs = images.select(F.col("path").alias("a"), (F.col("path") + 1).alias("b"))
    return X.pair_figures(pairs, images)


@query(sql("""SELECT t.path AS a, round(list_sum(list_transform(range(1, 65), lambda i: abs(t.px[i] - u.px[i]))) / 64.0::DOUBLE, 6) AS diff_mean, CAST(list_max(list_transform(range(1, 65), lambda i: abs(t.px[i] - u.px[i]))) AS DOUBLE) AS diff_max,
    100.0::DOUBLE * len(list_filter(range(1, 65), lambda i: abs(t.px[i] - u.px[i]) > 30)) / 64 AS diff_percent FROM tiles t JOIN tiles u ON u.path = t.path + 1""", "tiles"))  # fmt: skip
def tile_pixel_diff(spark, d):
    return tile_pair_figures(spark, d).select("a", "diff_mean", "diff_max", "diff_percent")


_GROUPED = """SELECT t.path // 40 AS group_id, t.path AS a, u.path AS b, round(list_sum(list_transform(range(1, 65), lambda i: abs(t.px[i] - u.px[i]))) / 64.0::DOUBLE, 6) AS diff_mean, CAST(list_max(list_transform(range(1, 65), lambda i: abs(t.px[i] - u.px[i]))) AS DOUBLE) AS diff_max,
    CASE WHEN t.path % 3 = u.path % 3 THEN '' ELSE 'camera' END AS differing FROM tiles t JOIN tiles u ON t.path // 40 = u.path // 40 AND t.path < u.path"""


@query(sql(_GROUPED, "tiles"))
def group_figures(spark, d):
    """Every pair of tiles of every group of forty, with metadata."""
    tiles = T.tiles(spark, d)
    images = tiles.select("path", *I.grey_tile(F.col("px"), 8))
    tags = tiles.select("path", F.create_map(F.lit("camera"), (F.col("path") % 3).cast("string")).alias("metadata"))
    members = tiles.select(F.expr("path div 40").alias("group_id"), "path")
    return X.group_figures(members, images, tags).select("group_id", "a", "b", "diff_mean", "diff_max", F.array_join("differing", ",").alias("differing"))


@query()
def tile_figures(spark, d):
    """Noise, recompression error and edge share of every tile."""
    return X.single_figures(T.tiles(spark, d).select("path", *I.grey_tile(F.col("px"), 8))).drop("histogram")


_NIBBLES = "array_to_string(list_transform(range(0, 16), lambda j: substr('0123456789abcdef', CAST(1 + list_sum(list_transform(range(0, 4), lambda b: CASE WHEN 64 * px[4 * j + b + 1] > list_sum(px) THEN 8 >> CAST(b AS INTEGER) ELSE 0 END)) AS INTEGER), 1)), '')"


@query(sql(f"SELECT path, {_NIBBLES} AS ahash FROM tiles", "tiles"))
def tile_hashes(spark, d):
    """The average hash of every tile; tiles have the hash's own size, so SQL can state it."""
    images = T.tiles(spark, d).select(F.col("path").cast("string").alias("path"), *I.grey_tile(F.col("px"), 8))
    return I.image_hashes(images).select(F.col("path").cast("long").alias("path"), "ahash")


@query()
def tile_fingerprints(spark, d):
    """All four perceptual hashes of every tile."""
    images = T.tiles(spark, d).select(F.col("path").cast("string").alias("path"), *I.grey_tile(F.col("px"), 8))
    return I.image_hashes(images).drop("stage", "error_type", "error_message")


def _zips(spark, d) -> DataFrame:
    docs = T.table(spark, d, "documents")
    return A.zip_rows(docs, F.concat(F.lit("/zips/"), F.expr("doc_id div 50"), F.lit(".zip")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))


@query("SELECT '/zips/' || (doc_id // 50) || '.zip' AS archive, doc_id || '.txt' AS member, strlen(text) AS length, md5(text) AS md5 FROM documents")
def archive_members(spark, d):
    """Documents zipped by fifties, and the archives' members read back."""
    return A.explode_archives(_zips(spark, d)).filter("error_type is null").select("archive", "member", "length", F.md5("content").alias("md5"))


@query("SELECT '/outer/' || (doc_id // 500) || '.zip//zips/' || (doc_id // 50) || '.zip' AS archive, doc_id || '.txt' AS member, md5(text) AS md5 FROM documents")
def nested_archives(spark, d):
    """Archives of archives."""
    inner = _zips(spark, d).withColumn("n", F.regexp_extract("path", r"(\d+)\.zip$", 1).cast("long"))
    outer = A.zip_rows(inner, F.concat(F.lit("/outer/"), F.expr("n div 10"), F.lit(".zip")), F.col("path"), F.col("content"))
    return A.expand_nested(outer).filter("error_type is null").select("archive", "member", F.md5("content").alias("md5"))


@query("SELECT '/zips/' || (doc_id // 50) || '.zip' AS archive, doc_id || '.txt' AS member FROM documents WHERE doc_id % 2 = 1")
def pruned_archives(spark, d):
    """Every archive without its even members, and what is left of it."""
    rows = materialise(A.explode_archives(_zips(spark, d)), "members")
    gone = rows.filter(F.regexp_extract("member", r"\d+", 0).cast("long") % 2 == 0).select("archive", "member")
    kept = A.prune_archives(rows, gone).select(F.col("archive").alias("path"), "content")
    return A.explode_archives(kept).filter("error_type is null").select("archive", "member")


def _streamed(spark, d) -> str:
    """The hashes arrive as a stream of files; each batch is compared with all before it. The folder of what is known then."""
    from kindred.streaming.incremental import incremental_groups, run_now

    at, schema = fresh_path(spark, "stream"), "scope string, ord long, md5 string, h long"
    T.hashes(spark, d).select("scope", "ord", "md5", "h").repartition(3).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    run_now(incremental_groups(stream, f"{at}/state", f"{at}/checkpoint"))
    return f"{at}/state"


@query(sql("SELECT a, b, dist FROM edges", "base", "hashes", "edges"))
def stream_incremental(spark, d):
    """The links of all files after the stream."""
    from kindred.streaming.incremental import current_file_edges

    return current_file_edges(spark, _streamed(spark, d))


@query(sql("SELECT ord, first_ord FROM comp", "base", "hashes", "edges", "linked", "reach", "comp", recursive=True))
def stream_groups(spark, d):
    """The groups after the stream."""
    from kindred.streaming.incremental import current_members

    return current_members(spark, _streamed(spark, d))
