"""Incremental scans: file streams, and groups kept up to date batch by batch.

The state of a directory is a set of tables that only grow, one folder for each batch,
and a manifest for each batch that is finished. A batch writes its tables first and its
manifest last, by one rename; readers look at batches with a manifest only. So a batch
that was interrupted between two writes has happened in no table, and when it runs again
it replaces what it had left.
"""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from kindred.functions import scalars as S
from kindred.operators.components import connected_components
from kindred.operators.similarity import edges_of_files, hamming_pairs, scope_key
from kindred.plans.joins import join_counted
from kindred.plans.storage import materialise
from kindred.sources.listing import every_file

FILES_PER_TRIGGER = 10_000
#: The tables of a state: files as they came, pairs of near hashes that a batch brought, and hashes with a new label.
ROWS = "scope string, ord long, md5 string, h long"
EDGES = "s string, x long, y long, dist int"
LABELS = "s string, h long, label long"


def watch_files(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("image",), recursive: bool = False) -> DataFrame:
    """A stream of new files' ``path, length, mtime, content``; edits and deletions come from ``watch_changes``."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", str(recursive).lower()).option("maxFilesPerTrigger", FILES_PER_TRIGGER).load(path)
    return stream.filter(S.kind(F.col("path")).isin(*kinds)).select("path", "length", F.col("modificationTime").alias("mtime"), "content")


def once_each(stream: DataFrame, key: str = "path", time: str = "mtime", delay: str = "1 day") -> DataFrame:
    """Drops paths delivered again within the watermark, so state stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def record_listing(spark: SparkSession, path: str, directory: str, seen_at: dt.datetime) -> None:
    """Append a listing of all files under ``path``, empty ones too, to the folder that ``watch_changes`` follows."""
    every_file(spark, path).withColumn("seen_at", F.lit(seen_at).cast("timestamp")).write.mode("append").parquet(directory)


def watch_changes(listings: DataFrame, gone_after: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """A stream ``path, status, length, mtime, at`` of new, modified and deleted files, from a stream of listings.

    ``listings``: ``path, length, mtime, seen_at``, every file once in each listing. The
    state holds a row for each file that is there. A file is modified if its size or time
    is another one than when it was last seen, and deleted once the listings' time has
    gone on for ``gone_after`` without it; then its state goes, and it is new if it comes
    back. Rows that come later than newer ones of their file change nothing.
    """
    wait = int(pd.Timedelta(gone_after).total_seconds() * 1000)
    names = ["path", "status", "length", "mtime", "at"]

    def follow(key, parts, state):
        path, out = key[0], []
        size, mtime, seen = state.getOption or (None, None, None)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(path, "deleted", size, pd.Timestamp(mtime, unit="us"), pd.Timestamp(seen + wait, unit="ms"))], columns=names)
            return
        rows = pd.concat(list(parts)).sort_values("seen_at")
        for new_size, when, at in zip(rows["length"], rows["mtime"], rows["seen_at"], strict=True):
            ms, us = at.value // 1_000_000, when.value // 1000
            if seen is not None and ms < seen:
                continue
            if seen is not None and ms - seen > wait:
                out.append((path, "deleted", size, pd.Timestamp(mtime, unit="us"), pd.Timestamp(seen + wait, unit="ms")))
                seen = None
            if seen is None or (size, mtime) != (int(new_size), us):
                out.append((path, "new" if seen is None else "modified", int(new_size), when, at))
            size, mtime, seen = int(new_size), us, ms
        state.update((size, mtime, seen))
        state.setTimeoutTimestamp(max(seen + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    rows = listings.select("path", "length", "mtime", "seen_at").withWatermark("seen_at", late)
    return rows.groupBy("path").applyInPandasWithState(follow, "path string, status string, length long, mtime timestamp, at timestamp", "length long, mtime long, seen long", "append", GroupStateTimeout.EventTimeTimeout)


class State:
    """The tables and manifests under a directory, which any store that Spark reaches can hold."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *names: path("/".join((self.directory, *names)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """The numbers of the finished batches, ascending."""
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        """A table's rows of all finished batches (of those ``before`` a number)."""
        paths = [f"{self.directory}/{table}/batch={n}" for n in self.committed() if before is None or n < before]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.directory}/{table}/batch={batch}")

    def commit(self, batch: int, **counts: int) -> None:
        """Write the batch's manifest under another name and rename it, which is what finishes the batch."""
        ready, made = self._path("manifests", f"{batch}.json"), self._path("manifests", f".{batch}.tmp")
        out = self._fs.create(made, True)
        try:
            out.write(bytearray(json.dumps({"batch": batch, **counts}).encode()))
        finally:
            out.close()
        if not self._fs.rename(made, ready) and not self._fs.exists(ready):
            raise OSError(f"batch {batch} could not be finished")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row for each hash of a scope: its first file, and the least and the greatest digest among its files."""
    kind = F.coalesce(F.concat(F.lit("m"), "md5"), F.lit(""))
    return rows.filter("h is not null").groupBy(scope_key(F.col("scope")).alias("s"), "h").agg(F.min("ord").alias("first"), F.min(kind).alias("lo"), F.max(kind).alias("hi"))


def _labels(state: State, before: int | None = None) -> DataFrame:
    """Each hash's present label: labels only fall, so it is the least that any batch has written."""
    return state.read("labels", LABELS, before).groupBy("s", "h").agg(F.min("label").alias("label"))


def add_batch(state: State, batch: DataFrame, number: int, threshold: int = 10) -> None:
    """Compare a batch's ``scope, ord, md5, h`` rows with all before it, and bring the groups up to date.

    Only the batch's own hashes probe. Hashes stand for all their files: two hashes are
    linked unless all files of both are copies of one. A group's label is its smallest
    ``ord``. The links of a batch are contracted over the labels that the groups have;
    only groups that get another label are written. A file that is known already and a
    batch that is finished change nothing.
    """
    if number in state.committed():
        return
    known = state.read("hashes", ROWS, number)
    own = batch.select("scope", "ord", "md5", "h").groupBy("ord").agg(F.min(F.struct("scope", "md5", "h")).alias("r")).select("r.scope", "ord", "r.md5", "r.h")
    own = materialise(own.join(known.select("ord"), "ord", "left_anti").select("scope", "ord", "md5", "h"), "batch")
    both = known.unionByName(own)
    fresh = _nodes(own).select("s", "h")
    pairs = materialise(hamming_pairs(both, threshold, fresh=own).select(scope_key(F.col("scope")).alias("s"), "x", "y", "dist"), "pairs")
    touched = pairs.select("s", F.col("x").alias("h")).unionByName(pairs.select("s", F.col("y").alias("h"))).unionByName(fresh).distinct()
    nodes = _nodes(both).join(touched, ["s", "h"], "left_semi")
    old = _labels(state, number)
    nodes = materialise(nodes.join(old, ["s", "h"], "left").withColumn("at", F.coalesce("label", "first")), "nodes")
    side = lambda c: nodes.select("s", F.col("h").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in ("at", "lo", "hi")])
    copies = (F.col("lo_x") == F.col("hi_x")) & (F.col("lo_y") == F.col("hi_y")) & (F.col("lo_x") == F.col("lo_y"))
    linked = materialise(pairs.join(side("x"), ["s", "x"]).join(side("y"), ["s", "y"]).filter(~copies).select("s", "x", "y", "dist", "at_x", "at_y"), "links")
    grouped = nodes.join(linked.select("s", F.col("x").alias("h")).unionByName(linked.select("s", F.col("y").alias("h"))).distinct(), ["s", "h"], "left_semi").unionByName(nodes.filter("lo < hi or label is not null")).distinct()
    grouped = materialise(grouped, "grouped")
    ends = linked.select(F.col("at_x").alias("src"), F.col("at_y").alias("dst")).unionByName(grouped.select(F.col("at").alias("src"), F.col("first").alias("dst")))
    merged = materialise(connected_components(ends).select(F.col("node").alias("at"), F.col("component").alias("new")), "merged")
    changed = old.withColumnRenamed("label", "at").join(merged, "at").filter("new < at").select("s", "h", F.col("new").alias("label"))
    added = grouped.filter("label is null").join(merged, "at").select("s", "h", F.col("new").alias("label"))
    labels = materialise(changed.unionByName(added), "new-labels")
    state.write(linked.select("s", "x", "y", "dist"), "edges", number)
    state.write(own, "hashes", number)
    state.write(labels, "labels", number)
    state.commit(number, files=own.count(), labels=labels.count())


def incremental_groups(stream: DataFrame, directory: str, checkpoint: str, threshold: int = 10) -> DataStreamWriter:
    """Keep hashes, links and groups under ``directory`` as ``scope, ord, md5, h`` rows arrive."""

    def apply(batch: DataFrame, number: int) -> None:
        add_batch(State(batch.sparkSession, directory), batch, number, threshold)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def current_edges(spark: SparkSession, directory: str) -> DataFrame:
    """``(scope, x, y, dist)``: the linked hashes known so far, x < y."""
    found = State(spark, directory).read("edges", EDGES)
    return found.select(F.when(F.col("s") != "", F.substring("s", 2, 1 << 30)).alias("scope"), "x", "y", "dist").distinct()


def current_file_edges(spark: SparkSession, directory: str) -> DataFrame:
    """``(a, b, dist)``, a < b by ``ord``: all links of files known so far, those of different files under one hash too."""
    return edges_of_files(State(spark, directory).read("hashes", ROWS), current_edges(spark, directory))


def current_members(spark: SparkSession, directory: str) -> DataFrame:
    """``(ord, first_ord)`` of all groups known so far; files of one hash needn't meet in one task."""
    state = State(spark, directory)
    rows = state.read("hashes", ROWS).filter("h is not null").select(scope_key(F.col("scope")).alias("s"), "h", "ord")
    sizes = rows.groupBy("s", "h").agg(F.count("*").alias("n"))
    labels = materialise(_labels(state).join(sizes, ["s", "h"]), "members")
    return join_counted(rows, labels, ["s", "h"], rows.count()).select("ord", F.col("label").alias("first_ord"))


def run_now(writer: DataStreamWriter):
    """Everything that has arrived, then stop; run it on a schedule, or use ``every``."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def every(writer: DataStreamWriter, minutes: int = 30):
    """A batch every so many minutes until the query is stopped."""
    return writer.trigger(processingTime=f"{minutes} minutes").start()
