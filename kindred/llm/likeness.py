"""Near copies by the exact Jaccard similarity of word shingles.

Shingles have one order: rare ones first, as far as a sample tells, then by hash. If
two texts are as alike as asked, the first shingle that they share lies in the prefix
of both: a text can't have more shingles before it than two such texts may differ in.
So texts meet by the shingles of their prefixes, no pair is missed whatever the order
is, and whole sets decide. (Of a SimHash's 64 bits a pair at 0.8 differs in about 10,
which a covering code can't reach without meeting unlike texts too.)
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kindred.llm.common import map_rows
from kindred.operators.components import connected_components
from kindred.plans.storage import discard, materialise

#: Of so many texts one is counted to tell common shingles, and so many of them are known at most. That changes the order, not the pairs.
SAMPLED, MAX_COMMON = 8, 1 << 18
#: Bins that a text's shingles are counted in; the smaller counts of two texts add up to what they share at most.
BINS = 256
#: Texts of one bucket that are held against others in one task, on each side.
CHUNK = 256
_NO_ID = -(1 << 63)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Hashes of the text's distinct word shingles, ascending. Words as in SimHash; fewer than ``width`` make one shingle, none an empty set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    if not width:
        return h
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(29)))


def prefix(found: np.ndarray, least: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of a text's ascending shingles in the order, one of which every text as alike as ``least`` has among its own; ``common`` ones (ascending) come last, by their ``counts``."""
    n = len(found) - ceil(len(found) * least - 1e-9) + 1
    if not len(found) or not len(common):
        return found[:n]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")[:n]]


def _signed(found: np.ndarray) -> np.ndarray:
    return found.view(np.int64)


def _common(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in two or more of the sampled texts, ascending, and in how many; the most common ones, of which there is a bounded number."""

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t or "", width) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(sets)) if sets else [], pa.int64())], ["shingle"])

        return kernel

    sample = _keyed(docs, id_col, text_col).filter(F.pmod("text_hash", F.lit(SAMPLED)) == 0).select("text")
    counted = map_rows(sample, make, "shingle long").groupBy("shingle").count().filter("count > 1")
    found = counted.orderBy(F.desc("count"), "shingle").limit(MAX_COMMON).toArrow()
    common, counts = found.column("shingle").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(common)
    return common[order], counts[order]


def _signatures(docs: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    """``(k, no_id, text_hash, cls, size, prefix, bins)``: ``cls`` is equal for equal sets of shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, id_col, text_col, width))

    def make():
        common, counts = shared.value

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t or "", width) for t in batch.column("text").to_pylist()]
            cls = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets))
            firsts = [prefix(s, least, common, counts) for s in sets]
            offsets = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(np.concatenate(firsts)) if firsts else [], pa.int64()))
            bins = np.array([np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS) for s in sets], np.int32).ravel()
            bins = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BINS), pa.array(bins))
            own = [*(batch.column(c) for c in ("k", "no_id", "text_hash")), pa.array(_signed(cls)), pa.array(list(map(len, sets)), pa.int64()), keys, bins]
            return pa.RecordBatch.from_arrays(own, ["k", "no_id", "text_hash", "cls", "size", "prefix", "bins"])

        return kernel

    return map_rows(_keyed(docs, id_col, text_col), make, "k long, no_id boolean, text_hash long, cls long, size long, prefix array<long>, bins array<int>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = F.col(id_col).cast("long")
    return docs.select(F.coalesce(own, F.lit(_NO_ID)).alias("k"), own.isNull().alias("no_id"), text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``(cls, shingles)`` for one text of each wanted ``(k, text_hash, cls)``."""

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [_signed(shingles(t or "", width)) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.list_(pa.int64()))], ["cls", "shingles"])

        return kernel

    texts = _keyed(docs, id_col, text_col).join(wanted, ["k", "text_hash"]).select("cls", "text")
    return map_rows(texts, make, "cls long, shingles array<long>").dropDuplicates(["cls"])


def _possible(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of the ``(src, dst)`` pairs whose counts in bins don't rule it out that they are alike enough."""
    side = lambda c, n, b: classes.select(F.col("cls").alias(c), F.col("size").alias(n), F.col("bins").alias(b))
    both = pairs.join(side("src", "m", "x"), "src").join(side("dst", "n", "y"), "dst")
    most = F.aggregate(F.zip_with("x", "y", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return both.filter(most >= (F.col("m") + F.col("n") - most) * least - 1e-6).select("src", "dst")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the ``(src, dst)`` pairs whose sets are alike enough."""
    both = pairs.join(sets.select(F.col("cls").alias("src"), F.col("shingles").alias("x")), "src").join(sets.select(F.col("cls").alias("dst"), F.col("shingles").alias("y")), "dst")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared / (F.size("x") + F.size("y") - shared) >= least).select("src", "dst")


def forest(cls: np.ndarray, label: np.ndarray, home: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of texts that are alike enough and not under one label yet, each home against all."""
    label = np.unique(label, return_inverse=True)[1]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids, starts = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes) - sizes
    mark = np.zeros(ids.max(initial=-1) + 1, np.int64)
    left, right = [], []
    for i in np.flatnonzero(home):
        if not (label != label[i]).any():
            break
        own = ids[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids], starts)
        mark[own] = 0
        near = np.flatnonzero((shared / (sizes + sizes[i] - shared) >= least) & (label != label[i]))
        _, first = np.unique(label[near], return_index=True)
        left += [cls[i]] * len(first)
        right += list(cls[near[first]])
        label[np.isin(label, label[near])] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _rest(members: DataFrame, labels: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """Links within the buckets whose texts aren't all under one label: all but those under the most common are held against all."""
    labelled = members.filter("n > 2").select("cls", "bucket", "n").join(labels.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("label", F.coalesce("component", "cls")).drop("component")
    labelled = materialise(labelled, "labelled")
    common = labelled.groupBy("bucket", "n", "label").count().groupBy("bucket", "n").agg(F.max(F.struct("count", "label")).alias("most"))
    chunks = lambda n: F.ceil(n / CHUNK).cast("int")
    mixed = common.filter(F.col("most.count") < F.col("n")).select("bucket", F.col("most.label").alias("most"), chunks(F.col("n") - F.col("most.count")).alias("si"), chunks(F.col("n")).alias("sj"))
    rows = materialise(labelled.drop("n").join(mixed, "bucket").withColumn("home", F.col("label") != F.col("most")), "mixed")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    homes = rows.filter("home").select("bucket", own("si").alias("i"), every("sj").alias("j"), "cls", "label", "home")
    others = rows.select("bucket", every("si").alias("i"), own("sj").alias("j"), "cls", "label", F.lit(False).alias("home"))

    def kernel(t: pa.Table) -> pa.Table:
        held = t.column("shingles").combine_chunks()
        found = [held[i].values.to_numpy(zero_copy_only=False) for i in range(len(held))]
        a, b = forest(t.column("cls").to_numpy(), t.column("label").to_numpy(), t.column("home").to_numpy(), found, least)
        return pa.table({"src": a, "dst": b})

    return homes.unionByName(others).join(sets_of(rows.select("cls")), "cls").groupBy("bucket", "i", "j").applyInArrow(kernel, "src long, dst long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``(k, no_id, text_hash, component)`` for every row: its component over pairs with a Jaccard similarity of ``least`` or more.

    Equal sets are collapsed first. Texts of similar sizes that share a shingle of their
    prefixes are a bucket. In each the first text is held against the
    others, a row each; only where that leaves a bucket in parts are the parts compared,
    in tiles of bounded size. Texts without words are alike. ``k`` is the id, null the
    smallest long.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity lies above 0 and is 1 at most")
    rows = materialise(_signatures(docs, id_col, text_col, width, least), "signatures")
    classes = materialise(rows.select("cls", "size", "prefix", "bins").dropDuplicates(["cls"]), "classes")
    dealt = classes.select("cls", "size", F.explode("prefix").alias("shingle")).repartition("shingle")
    shared = dealt.join(dealt.groupBy("shingle").count().filter("count > 1").select("shingle"), "shingle")
    # Of two alike texts the smaller has that share of the other's size at least, so they are in one class of sizes or in neighbouring ones.
    size_class = F.floor(F.log("size") / max(-log(least) * 1.001, 0.001))
    shared = materialise(shared.select("cls", "size", F.explode(F.array(size_class, size_class + 1)).alias("class"), "shingle").select("cls", "size", F.xxhash64("shingle", "class").alias("bucket")), "shared")
    sized = shared.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("cls", "size")).alias("one"), F.bit_xor(F.xxhash64("cls")).alias("who")).filter("n > 1")
    once = sized.groupBy("n", "one", "who").agg(F.min("bucket").alias("bucket"))  # buckets of the same texts
    members = materialise(shared.join(once.select("bucket", "n", "one"), "bucket"), "members")
    discard(shared)

    def sets_of(wanted: DataFrame) -> DataFrame:
        chosen = rows.groupBy("cls").agg(F.min(F.struct("k", "text_hash")).alias("one")).join(wanted.distinct(), "cls", "left_semi")
        return materialise(_sets(docs, chosen.select("cls", "one.k", "one.text_hash"), id_col, text_col, width), "sets")

    fit = F.least("size", "one.size") >= F.greatest("size", "one.size") * least - 1e-9
    pairs = members.filter((F.col("cls") != F.col("one.cls")) & fit).select(F.col("cls").alias("src"), F.col("one.cls").alias("dst")).distinct()
    pairs = materialise(_possible(pairs, classes, least), "pairs")
    sets = sets_of(pairs.select(F.col("src").alias("cls")).unionByName(pairs.select(F.col("dst").alias("cls"))))
    labels = connected_components(_alike(pairs, sets, least))
    discard(sets, pairs, classes)
    more = materialise(_rest(members, labels, sets_of, least), "links")
    if not more.isEmpty():
        labels = connected_components(labels.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more))
    classes = labels.withColumnRenamed("node", "cls")
    return rows.join(classes, "cls", "left").select("k", "no_id", "text_hash", F.coalesce("component", "cls").alias("component"))
