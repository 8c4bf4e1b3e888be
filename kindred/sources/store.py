"""Tables that outlive a scan: fingerprint cache, session log, errors; and what changed between scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from kindred.functions import scalars as S
from kindred.functions.scalars import source_key
from kindred.plans.storage import materialise

KEY = ["path", "length", "mtime"]
_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def cache_lookup(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(hits, misses)`` by path, size and time; entries with an empty top hash don't count."""
    fresh = cache.filter("phash_top <> ''")
    return files.join(fresh, KEY), files.join(fresh, KEY, "left_anti")


def cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest row for each key; a tie goes to the new row."""
    both = cache.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = W.partitionBy(*KEY).orderBy(F.desc("computed_at"), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__new")


class CacheTable:
    """The fingerprint cache as a table of the catalog: dealt by path into parts and by key into buckets.

    A lookup shuffles the files only, since the buckets are what a join on the key asks
    for. An upsert reads and writes the parts that hold a new path; others stay as they
    are. The files lie at ``location``; a session that doesn't know the table yet finds
    them there.
    """

    def __init__(self, spark: SparkSession, name: str, location: str, columns: str, parts: int = 32, buckets: int = 32) -> None:
        self.spark, self.name, self.parts, self.buckets = spark, name, parts, buckets
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, part INT) USING parquet PARTITIONED BY (part) CLUSTERED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{location}'")
        where = spark._jvm.org.apache.hadoop.fs.Path(location)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
        spark.catalog.recoverPartitions(name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``cache_lookup`` of files in the table."""
        return cache_lookup(files, self.rows().drop("part"))

    def upsert(self, new: DataFrame) -> list[int]:
        """The newest row for each key, a tie to the new one; the parts that were written. A path of several keys keeps a row for each."""
        own = materialise(new.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int")), "new-entries")
        touched = sorted(r["part"] for r in own.select("part").distinct().collect())  # as many as there are parts, at most
        if touched:
            both = cache_upsert(self.rows().filter(F.col("part").isin(touched)), own.select(self.rows().columns))
            kept = materialise(both, "entries").repartition(self.buckets, *KEY)
            before = self.spark.conf.get(_OVERWRITE)
            self.spark.conf.set(_OVERWRITE, "dynamic")  # of tables in the catalog only the session says what an overwrite replaces
            try:
                kept.write.mode("overwrite").insertInto(self.name)
            finally:
                self.spark.conf.set(_OVERWRITE, before)
        return touched


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite a table that ``df`` may read from: the new rows are written elsewhere first."""
    materialise(df, "swap").write.mode("overwrite").parquet(path)


def clear_table(spark: SparkSession, path: str) -> None:
    spark.read.parquet(path).limit(0).write.mode("overwrite").parquet(path)


def open_session(spark: SparkSession, scan_id: int, sources: list[str], started_at: dt.datetime) -> DataFrame:
    """One row of the session log; totals are null until it is closed."""
    row = spark.createDataFrame([(scan_id, sources, started_at)], "scan_id long, sources array<string>, started_at timestamp")
    return row.select("scan_id", source_key(F.col("sources")).alias("source_key"), "started_at", F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("long").alias("total_files"), F.lit(None).cast("long").alias("total_groups"))


def record_files(recorded: DataFrame, scan_id: int, files: DataFrame) -> DataFrame:
    """The recorded ``scan_id, path, length, mtime`` rows with a session's files; a path recorded again replaces its row."""
    last = F.max(F.struct("mtime", "length")).alias("r")  # of a path listed twice the later row, so that reruns agree
    new = files.groupBy("path").agg(last).select(F.lit(scan_id).cast("long").alias("scan_id"), "path", "r.length", "r.mtime")
    return recorded.join(new.select("scan_id", "path"), ["scan_id", "path"], "left_anti").select(new.columns).unionByName(new)


def close_session(history: DataFrame, scan_id: int, groups: DataFrame, finished_at: dt.datetime) -> DataFrame:
    """The log with the session's totals: groups, and files counted once for every group they are in."""
    totals = groups.agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("f"), F.count("*").alias("g"))
    own = F.col("scan_id") == scan_id
    out = history.crossJoin(F.broadcast(totals))  # one row
    return out.withColumn("finished_at", F.when(own, F.lit(finished_at)).otherwise(F.col("finished_at"))).withColumn("total_files", F.when(own, F.col("f")).otherwise(F.col("total_files"))).withColumn("total_groups", F.when(own, F.col("g")).otherwise(F.col("total_groups"))).drop("f", "g")


def last_session(history: DataFrame, key: str) -> DataFrame:
    """The latest finished session of the same sources."""
    return history.filter((F.col("source_key") == key) & F.col("finished_at").isNotNull()).orderBy(F.desc("scan_id")).limit(1)


def retain(history: DataFrame, files: DataFrame, cutoff: dt.datetime | str) -> tuple[DataFrame, DataFrame]:
    """Sessions started at ``cutoff`` or later, and their file rows."""
    kept = history.filter(F.col("started_at") >= F.lit(cutoff).cast("timestamp"))
    return kept, files.join(kept.select("scan_id"), "scan_id", "left_semi")


def scan_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, status)``: new, modified, deleted or same, from ``path, length, mtime`` of two scans."""
    p = previous.select("path", F.col("length").alias("pl"), F.col("mtime").alias("pm"), F.lit(True).alias("was"))
    c = current.select("path", F.col("length").alias("cl"), F.col("mtime").alias("cm"), F.lit(True).alias("is"))
    same = F.col("pl").eqNullSafe(F.col("cl")) & F.col("pm").eqNullSafe(F.col("cm"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "deleted").when(same, "same").otherwise("modified")
    return p.join(c, "path", "full_outer").select("path", status.alias("status"))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and the dead letters ``(path, stage, error_type, message)``; kernels leave ``error_type`` null if all went well."""
    bad = rows.filter("error_type is not null").select("path", "stage", "error_type", F.col("error_message").alias("message"))
    return rows.filter("error_type is null").drop("stage", "error_type", "error_message"), bad


def earlier_folders(files: DataFrame, base: str) -> DataFrame:
    """``(path, n_images)``: the folders directly under ``base``, where archives were extracted before, with the images below each."""
    inside = files.filter(F.col("path").startswith(base.rstrip("/") + "/"))
    rest = F.substring_index(F.substring(F.col("path"), len(base.rstrip("/")) + 2, 1 << 30), "/", 1)
    folder = F.concat(F.lit(base.rstrip("/") + "/"), rest)
    return inside.filter(folder != F.col("path")).groupBy(folder.alias("path")).agg(F.sum((S.kind(F.col("path")) == "image").cast("long")).alias("n_images"))


def pending(queue: DataFrame, done: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Queued paths, each once, that are neither done nor removed."""
    out = queue.dropDuplicates(["path"]).join(done.select("path"), "path", "left_anti")
    return out if removed is None else out.join(removed.select("path"), "path", "left_anti")
