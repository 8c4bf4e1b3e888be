"""Manifests of files: scans of folders, single files and mixed source lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from kindred.functions import scalars as S
from kindred.plans.options import ScanOptions
from kindred.plans.order import global_rank
from kindred.sources.listing import every_file


def list_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("image",), content: bool = False) -> DataFrame:
    """Files of the given kinds under a folder (or one file): ``path, original_path, length, mtime, format, kind, source_type, source_group``.

    Empty files are listed too (``size_guards`` makes errors of them). Without
    ``content`` no bytes are read. A folder without such files gives no rows.
    """
    found = every_file(spark, path)
    plain = F.regexp_replace("path", "^file:/*", "/")
    if content:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        whole = whole.select(plain.alias("path"), "length", F.col("modificationTime").alias("mtime"), "content")
        rows = whole.unionByName(found.filter("length = 0").select(plain.alias("path"), "length", "mtime", F.lit(b"").alias("content")))
    else:
        rows = found.select(plain.alias("path"), "length", "mtime")
    rows = rows.withColumn("kind", S.kind(F.col("path"))).filter(F.col("kind").isin(*kinds))
    return rows.select("path", F.col("path").alias("original_path"), "length", "mtime", S.format_name(F.col("path")).alias("format"), "kind", F.lit("folder").alias("source_type"), F.lit(None).cast("string").alias("source_group"), *(["content"] if content else []))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Manifests under one another with ``source_ord`` and ``ord``; of a path seen twice the first source's row stays."""
    numbered = [s.withColumn("source_ord", F.lit(i)) for i, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    first = both.withColumn("__r", F.row_number().over(W.partitionBy("path").orderBy("source_ord"))).filter("__r = 1").drop("__r")
    return with_order(first)


def with_order(manifest: DataFrame) -> DataFrame:
    """With ``ord``, the place by source and path from 0."""
    return global_rank(manifest, "ord", F.asc("source_ord"), F.asc("path"), first=0)


def size_guards(files: DataFrame, most: int = ScanOptions.max_file_bytes) -> DataFrame:
    """``error_type`` and ``error_message`` of files that are empty or too large; apply before the bytes are read."""
    bad = F.when(F.coalesce("length", F.lit(0)) == 0, "EmptyFile").when(F.col("length") > most, "FileTooLarge")
    return files.withColumn("stage", F.lit("hash")).withColumn("error_type", bad).withColumn("error_message", F.when(bad.isNotNull(), F.concat(F.lit("length "), F.coalesce("length", F.lit(0)).cast("string"))))


def video_manifest(files: DataFrame, meta: DataFrame | None = None, interval: float = 2.0) -> DataFrame:
    """Video files with ``duration`` and ``keyframe_count`` from a table ``path, frames, fps``; 0 where unknown."""
    videos = files.filter(S.kind(F.col("path")) == "video")
    if meta is None:
        return videos.withColumn("duration", F.lit(0.0)).withColumn("keyframe_count", F.lit(0).cast("long"))
    joined = videos.join(meta.select("path", "frames", "fps"), "path", "left").na.fill(0, ["frames", "fps"])
    return joined.withColumn("duration", S.duration_seconds(F.col("frames"), F.col("fps"))).withColumn("keyframe_count", S.keyframe_count(F.col("frames"), F.col("fps"), interval)).drop("frames", "fps")


def new_on(files: DataFrame, day: Column) -> DataFrame:
    """Archives and documents last changed on ``day``, and folders that hold a file changed that day: ``(path, kind)``."""
    own = files.filter(S.kind(F.col("path")).isin("archive", "document") & (F.to_date("mtime") == day)).select("path", S.kind(F.col("path")).alias("kind"))
    folders = files.groupBy(S.parent(F.col("path")).alias("path")).agg(F.max("mtime").alias("mtime")).filter(F.to_date("mtime") == day)
    return own.unionByName(folders.select("path", F.lit("folder").alias("kind")))


def inventory(files: DataFrame) -> DataFrame:
    """``(dir, depth, n_images, n_direct)``: images in every folder, below it at any depth and directly in it."""
    images = files.filter(S.kind(F.col("path")) == "image").withColumn("parts", F.split(S.parent(F.col("path")), "/"))
    levels = images.select(F.size("parts").alias("n"), "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    rows = levels.select(F.concat_ws("/", F.slice("parts", F.lit(1), F.col("depth"))).alias("dir"), F.col("depth").cast("long").alias("depth"), (F.col("depth") == F.col("n")).cast("long").alias("direct"))
    return rows.groupBy("dir", "depth").agg(F.count("*").alias("n_images"), F.sum("direct").alias("n_direct"))


def count_kinds(files: DataFrame) -> DataFrame:
    return files.groupBy(S.kind(F.col("path")).alias("kind"), S.format_name(F.col("path")).alias("format")).agg(F.count("*").alias("n"))


def select_subtrees(files: DataFrame, checked: DataFrame) -> DataFrame:
    """Files that are checked or lie under a checked folder (``checked.path``), by equality on every ancestor."""
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat_ws("/", F.slice(parts, F.lit(1), k)))
    hit = files.select("path", F.explode(ancestors).alias("__a")).join(checked.select(F.col("path").alias("__a")), "__a", "left_semi").select("path").distinct()
    return files.join(hit, "path", "left_semi")
