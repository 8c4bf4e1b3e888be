"""SimHash near-duplicates found through covering-code anchors.

Fingerprints that differ in at most three of 64 bits agree, up to one bit, in one
half of 32 bits. In each half the words of the perfect Hamming code of length 31
are the anchors: every word lies within one bit (the covering radius) of exactly one
of them, its home. A fingerprint is replicated to every anchor within two bits
(radius 1 plus the half's share 1 of the threshold), 16 at most, so two linked
fingerprints always meet at the home of either one and are compared there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import map_rows, partitions, table
from kindred.llm.likeness import near_copies, text_hash as _text_hash
from kindred.operators.components import connected_components
from kindred.plans.joins import join_counted
from kindred.plans.storage import materialise

THRESHOLD = 3
#: Rows of one anchor that are compared in one task; larger anchors are dealt in tiles.
TILE = 8192
#: Groups up to this size are compared by plain expansion.
SMALL = 48
_HASHED_AT_ONCE = 1 << 16


def simhash(text: str, width: int = 3) -> int:
    """The 64-bit fingerprint of a text: majority of the XXH64 bits of its word shingles.

    A-Z are lowered, words are runs without ASCII white space; a text with fewer than
    ``width`` words has one shingle, a text without words the fingerprint zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    for lo in range(0, n, _HASHED_AT_ONCE):
        hi = min(n, lo + _HASHED_AT_ONCE)
        runs = (words[lo + k : hi + k] for k in range(width))
        h = np.fromiter(map(digest, map(b" ".join, zip(*runs, strict=True))), np.dtype(">u8"), hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row: the text's XXH64 and its SimHash as signed longs; null texts count as empty."""

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [_signed(simhash(t or "")) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())], ["doc_id", "text_hash", "fp"])

        return kernel

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_hash(F.col(text_col)).alias("text_hash"))
    return map_rows(rows, make, "doc_id long, text_hash long, fp long")


#: The pairs (i, j), i < j, of positions 1..31 with i xor j = s, for each syndrome s.
_PAIRS = [[(i, i ^ s) for i in range(1, 32) if i < (i ^ s)] if s else [] for s in range(32)]


def _anchor_masks() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome: what to flip to reach the anchors within two bits (home first), and how many they are."""
    masks, counts = np.zeros((32, 16), np.uint32), np.ones(32, np.int64)
    for s in range(1, 32):
        flips = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << (j - 1)) for i, j in _PAIRS[s]]
        masks[s, : len(flips)], counts[s] = flips, len(flips)
    return masks, counts


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Xor of the positions 1..31 that are set; zero for the anchors themselves."""
    out = np.zeros(len(half), np.uint32)
    for bit in range(5):
        at = sum(1 << (p - 1) for p in range(1, 32) if p >> bit & 1)
        out |= (np.bitwise_count(half & np.uint32(at)).astype(np.uint32) & 1) << np.uint32(bit)
    return out


def replicate(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor key, index of the fingerprint, and whether the anchor is its home, for both halves."""
    masks, counts = _anchor_masks()
    bits = fps.view(np.uint64)
    keys, index, home = [], [], []
    for half in (0, 1):
        word = (bits >> np.uint64(32 * half)).astype(np.uint32) & np.uint32(0x7FFFFFFF)
        s = _syndrome(word)
        n = counts[s]
        first = np.cumsum(n) - n
        which = np.repeat(np.arange(len(fps)), n)
        nth = np.arange(len(which)) - np.repeat(first, n)
        keys.append((word[which] ^ masks[s[which], nth]).astype(np.int64) | np.int64(half << 32))
        index.append(which)
        home.append(nth == 0)
    return np.concatenate(keys), np.concatenate(index), np.concatenate(home)


def _replicated(distinct: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for lo in range(0, len(fps), 2048):
                part = fps[lo : lo + 2048]
                key, which, home = replicate(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[which]), pa.array(home)], ["anchor", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "anchor long, fp long, home boolean")


def _forest(fps: np.ndarray, homes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``threshold`` in one group: fewer than it has members."""
    label = np.arange(len(fps))
    bits = fps.view(np.uint64)
    left, right = [], []
    for i in np.flatnonzero(homes):
        near = np.flatnonzero((np.bitwise_count(bits ^ bits[i]) <= threshold) & (label != label[i]))
        if len(near):
            roots, first = np.unique(label[near], return_index=True)
            left += [i] * len(first)
            right += near[first].tolist()
            label[np.isin(label, roots)] = label[i]
    return fps[np.array(left, np.int64)], fps[np.array(right, np.int64)]


def compare(fps: np.ndarray, homes: np.ndarray, starts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the groups that begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(fps)))
    left, right = [], []
    for lo, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        a, b = _forest(fps[lo : lo + n], homes[lo : lo + n], threshold)
        left.append(a)
        right.append(b)
    group = np.repeat(np.arange(len(starts)), sizes)
    rows = np.flatnonzero(homes & (sizes[group] > 1) & (sizes[group] <= SMALL))
    for k in range(0, len(rows), 1 << 16):
        own = rows[k : k + (1 << 16)]
        n = sizes[group[own]]
        a = np.repeat(own, n)
        b = np.repeat(starts[group[own]], n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = (np.bitwise_count(fps[a].view(np.uint64) ^ fps[b].view(np.uint64)) <= threshold) & (fps[a] != fps[b])
        left.append(fps[a[near]])
        right.append(fps[b[near]])
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def _links(dealt: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Compare rows that share ``keys``; they come sorted by them, group after group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def out(cols: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
            a, b = compare(cols[-2], cols[-1], starts, threshold)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["src", "dst"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "fp", "home")]
            if not len(cols[0]):
                continue
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:-2]], axis=0)
            starts = np.flatnonzero(new)
            kept = [c[starts[-1] :] for c in cols]
            if len(starts) > 1:
                yield out([c[: starts[-1]] for c in cols], starts[:-1])
        if kept is not None:
            yield out(kept, np.zeros(1, np.int64))

    return dealt.select(*keys, "fp", "home").mapInArrow(run, "src long, dst long")


def near_links(distinct: DataFrame, threshold: int = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``(src, dst)`` links that connect all distinct fingerprints within ``threshold`` (at most 3) bits.

    Links that others already imply within one anchor are left out; reachability is
    whole. An anchor with more than ``tile`` rows is dealt into square tiles of bounded
    size, every home chunk against every member chunk.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover thresholds from 0 to 3")
    spark = distinct.sparkSession
    n = partitions(spark)
    rows = materialise(_replicated(distinct), "anchors")
    large = materialise(rows.groupBy("anchor").count().filter(F.col("count") > tile), "hot")
    if large.isEmpty():
        return _links(rows.repartition(n, "anchor").sortWithinPartitions("anchor"), ["anchor"], threshold)
    cold = rows.join(large.select("anchor"), "anchor", "left_anti")
    hot = rows.join(large, "anchor").withColumn("side", F.ceil(2 * F.col("count") / tile).cast("int"))
    hot = hot.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("side")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    as_home = hot.filter("home").select("anchor", F.col("own").alias("i"), every.alias("j"), "fp", "home")
    as_member = hot.select("anchor", every.alias("i"), F.col("own").alias("j"), "fp", F.lit(False).alias("home"))
    tiles = as_home.unionByName(as_member)
    keys = ["anchor", "i", "j"]
    return _links(cold.repartition(n, "anchor").sortWithinPartitions("anchor"), ["anchor"], threshold).unionByName(_links(tiles.repartition(n, *keys).sortWithinPartitions(*keys), keys, threshold))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id)``: every row with the smallest id reachable over links.

    Equal fingerprints are collapsed to one before anything is compared, so a group of
    copies of any size costs one row. Null and empty texts have fingerprint zero and
    link like any other; repeated ids keep a row each; null ids never name a component
    unless all its ids are null; an empty table gives no rows.
    """
    docs_fp = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    labels = connected_components(near_links(distinct.repartition(partitions(docs.sparkSession), "fp"), threshold))
    labels = materialise(labels, "labels")
    labelled = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = materialise(labelled.join(smallest, "component").select("fp", "n", "component", "component_id"), "classes")
    return join_counted(docs_fp, classes, ["fp"], docs_fp.count()).select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, width: int = 5, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, but one for each component only: that of the smallest id.

    Components are those of ``near_duplicates`` within ``threshold`` bits or, given a
    ``similarity``, of pairs whose sets of ``width``-word shingles have that Jaccard
    similarity or more.
    Among rows with that id the one with the smallest hash of its text stays, and of
    equal rows one. What goes is decided on ids and hashes; texts are joined once.
    """
    key, text_hash = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), _text_hash(F.col(text_col))
    if similarity is None:
        rows = near_duplicates(docs, id_col, text_col, threshold)
        rows = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.col("doc_id").isNull().alias("no_id"), "text_hash", "component")
    else:
        rows = near_copies(docs, id_col, text_col, width, similarity)
    rows = materialise(rows, "members")
    first = F.min(F.struct("no_id", "k", "text_hash")).alias("first")
    kept = rows.groupBy("component").agg(first).select(F.col("first.k").alias("k"), F.col("first.text_hash").alias("text_hash"))
    gone = rows.join(kept, ["k", "text_hash"], "left_anti").select("k", "text_hash").distinct()
    out = docs.join(gone, (key == gone["k"]) & (text_hash == gone["text_hash"]), "left_anti")
    repeated = materialise(rows.groupBy("k", "text_hash").count().filter("count > 1").join(kept, ["k", "text_hash"], "left_semi"), "repeated")
    if repeated.isEmpty():
        return out
    again = (key == repeated["k"]) & (text_hash == repeated["text_hash"])
    once = out.join(repeated, again, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(repeated, again, "left_anti").unionByName(once)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint in hexadecimal and its near-duplicate class."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
