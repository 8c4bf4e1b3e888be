"""Ranked lexical search over hashed max-sketches.

The index holds a sketch of each document: every term is hashed to one of 65,536
coordinates, and a coordinate keeps the largest frequency of the terms that fall on it,
from which its largest impact follows (a term's impact grows with its frequency). The
sketch says nothing about the queries and takes a part of the text's size. A batch of
items is looked up in it at once: the sum of an item's term weights times the impacts of
their coordinates is an upper bound of the document's score, since another term can only
raise a coordinate. Documents are then scored exactly, from their texts, in descending
order of the bound, in growing portions, until no bound reaches an item's k-th best
score. Nothing is lost that way, whatever the bounds are worth; they only decide how
many texts are read again.

Equal texts are scored once, and their documents are ranked at the end.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from kindred.llm.common import slices, table, whole_text
from kindred.plans.storage import materialise

#: Coordinates of a sketch, 65,536 at most.
WIDTH = 1 << 16
#: Bits of the map of hashes of the items' terms, by which document frequencies are counted.
MAP_BITS = 1 << 23
#: Frequencies in a sketch stop here, where an impact counts as the largest possible.
MOST_TF = (1 << 16) - 1
#: Distinct terms of the items that are looked up at once, as an average of blocks.
BLOCK_TERMS = 500_000
#: Texts for each item in the first portion, and by how much portions grow.
PORTION, GROWTH = 32, 16
#: Keys of texts that may be broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
#: Bounds that a task holds at once.
HELD = 1 << 20
#: Bytes of terms in lower case: digits, letters and all bytes outside ASCII; others separate terms.
_TERM_BYTES = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in bytes(range(256)).lower())


def terms(text: str | bytes | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters and characters outside ASCII, with A-Z in lower case."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TERM_BYTES).split()


def impact(tf, m):
    """``(1000000000 tf) div (1000 tf + 12 m)``, which grows with tf towards 1,000,000."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _text_key(text: F.Column) -> F.Column:
    return F.unhex(F.md5(text.cast("binary")))


def _query_map(items: DataFrame, text_col: str) -> np.ndarray:
    """For each value of the hash whether some item's term has it; of a fixed size."""

    def run(batches):
        for batch in batches:
            for cut in slices(batch):
                found = {zlib.crc32(w) % MAP_BITS + 1 for t in cut.column("text").to_pylist() for w in terms(t)}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64())], ["at"])

    places = items.select(F.col(text_col).alias("text")).mapInArrow(run, "at long")
    rows = places.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()  # 4 KB for each 32,768 values
    out = np.zeros(MAP_BITS, bool)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(bytes(r["bits"]), np.uint8), bitorder="little").astype(bool)
        start = (r["bucket"] - 1) * len(bits)
        out[start : start + len(bits)] = bits[: MAP_BITS - start]
    return out


def build_index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """``(sketches, frequencies)``: ``doc_id, key, n, sketch`` for each row with a term, and ``term, df`` for terms of the items.

    ``key`` identifies the text, ``n`` counts its terms, ``sketch`` holds the coordinates
    in use (two bytes each) and then their frequencies (two bytes each). One pass over
    the texts makes both; every task adds up its document frequencies first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_query_map(items, item_text))

    def run(batches):
        wanted, df = shared.value, Counter()

        def counted():
            words, sums = list(df), list(df.values())
            df.clear()
            none = pa.nulls(len(words))
            return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(sums, pa.int64())], ["doc_id", "key", "n", "sketch", "term", "df"])

        for batch in batches:
            for cut in slices(batch):
                tf = [Counter(terms(t)) for t in cut.column("text").cast(pa.binary()).to_pylist()]
                flat = [w for c in tf for w in c]
                sizes = np.array([len(c) for c in tf], np.int64)
                h = np.fromiter(map(zlib.crc32, flat), np.int64, len(flat))
                df.update([flat[i] for i in np.flatnonzero(wanted[h % MAP_BITS]).tolist()])
                places = np.repeat(np.arange(len(tf)), sizes) * width + h % width
                counts = np.fromiter((v for c in tf for v in c.values()), np.int64, len(flat))
                order = np.argsort(places, kind="stable")
                places, counts = places[order], counts[order]
                first = np.flatnonzero(np.diff(places, prepend=-1))
                most = np.minimum(np.maximum.reduceat(counts, first), MOST_TF).astype("<u2") if len(first) else np.zeros(0, "<u2")
                at = (places[first] % width).astype("<u2")
                ends = np.searchsorted(places[first], np.arange(len(tf) + 1) * width).tolist()
                sketches = [at[a:b].tobytes() + most[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                n = pa.array([c.total() for c in tf], pa.int64())
                none = pa.nulls(len(tf))
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("key"), n, pa.array(sketches, pa.binary()), none.cast(pa.string()), none.cast(pa.int64())], ["doc_id", "key", "n", "sketch", "term", "df"])
                if len(df) > 500_000:
                    yield counted()
        if df:
            yield counted()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(whole_text(docs, text_col)).alias("key"), F.col(text_col).alias("text"))
    both = materialise(rows.mapInArrow(run, "doc_id long, key binary, n long, sketch binary, term string, df long").filter("term is not null or n > 0"), "sketches", "zstd")
    return both.filter("term is null").select("doc_id", "key", "n", "sketch"), both.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, item_id, term, times)`` for each distinct term of each item; equal rows are one item."""

    def run(batches):
        for batch in batches:
            for cut in slices(batch):
                found = [(i, d, w, n) for i, d, t in zip(*(cut.column(c).to_pylist() for c in ("item", "item_id", "text")), strict=True) for w, n in Counter(terms(t)).items()]
                columns = list(zip(*found, strict=True)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()).cast(pa.string()), pa.array(columns[3], pa.int64())], ["item", "item_id", "term", "times"])

    name = F.md5(F.concat_ws("\0", F.coalesce(F.col(id_col).cast("string"), F.lit("")), whole_text(items, text_col)).cast("binary"))
    rows = items.select(name.alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).dropDuplicates(["item", "item_id"])
    return rows.mapInArrow(run, "item string, item_id long, term string, times long")


@dataclass(frozen=True)
class Queries:
    """A block of items: their weights by term, and by coordinate as one list of postings."""

    weights: list[dict[bytes, int]]
    starts: np.ndarray
    items: np.ndarray
    values: np.ndarray
    documents: int
    terms: int

    @staticmethod
    def of(weights: list[dict[bytes, int]], documents: int, total: int, width: int = WIDTH) -> Queries:
        postings = sorted((zlib.crc32(w) % width, q, v) for q, own in enumerate(weights) for w, v in own.items())
        at, q, v = (np.array(c, np.int64) for c in zip(*postings, strict=True))
        return Queries(weights, np.searchsorted(at, np.arange(width + 1)), q, v.astype(float), documents, total)

    def length(self, n):
        """A document's m: 75 and 25 times its number of terms over the average."""
        return 75 + (25 * n * self.documents) // self.terms

    def bounds(self, n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        """An upper bound of the score of each document (row) for each item (column)."""
        sizes = np.array([len(s) // 4 for s in sketches], np.int64)
        raw = np.frombuffer(b"".join(sketches), "<u2").astype(np.int64)
        offset = np.arange(sizes.sum()) + np.repeat(np.cumsum(sizes) - sizes, sizes)  # coordinates of each sketch come before its frequencies
        at, tf = raw[offset], raw[offset + np.repeat(sizes, sizes)]
        many = self.starts[at + 1] - self.starts[at]
        used = np.flatnonzero(many)
        at, tf, many, doc = at[used], tf[used], many[used], np.repeat(np.arange(len(sizes)), sizes)[used]
        r = np.where(tf == MOST_TF, 1_000_000, impact(tf, self.length(n)[doc])).astype(float)
        each = np.repeat(np.arange(len(used)), many)
        posting = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + self.starts[at][each]
        k = len(self.weights)
        sums = np.bincount(doc[each] * k + self.items[posting], r[each] * self.values[posting], minlength=len(sizes) * k)
        return np.ceil(sums * (1 + 1e-12)).reshape(len(sizes), k)  # sums of whole numbers, exact below 2^53 and never too small

    def score(self, q: int, tf: Counter, m: int) -> int:
        return sum(w * impact(tf[t], m) for t, w in self.weights[q].items() if t in tf)


class Best:
    """The texts of a task with the largest bounds for each item, ties with the last included."""

    def __init__(self, items: int, portion: int, least: np.ndarray, under: np.ndarray) -> None:
        self.portion, self.cut, self.under = portion, least.copy(), under
        self.held = [np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 2), np.uint64)]
        self.items, self.room = items, 4 * items * portion

    def add(self, bounds: np.ndarray, keys: np.ndarray) -> None:
        d, q = np.nonzero((bounds >= self.cut) & (bounds < self.under))
        self.held = [np.concatenate(x) for x in zip(self.held, (q, bounds[d, q], keys[d]), strict=True)]
        if len(self.held[0]) > self.room:
            self.settle()
            self.room = max(self.room, 2 * len(self.held[0]))

    def settle(self) -> None:
        q, b, k = self.held
        order = np.lexsort((k[:, 1], k[:, 0], -b, q))
        q, b, k = q[order], b[order], k[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (k[1:] != k[:-1]).any(axis=1)
        q, b, k = q[new], b[new], k[new]
        first = np.searchsorted(q, np.arange(self.items))
        last = np.append(first[1:], len(q))
        full = np.flatnonzero(last - first >= self.portion)
        self.cut[full] = np.maximum(self.cut[full], b[first[full] + self.portion - 1])
        kept = b >= self.cut[q]
        self.held = [q[kept], b[kept], k[kept]]


def _largest_bounds(sketches: DataFrame, queries, portion: int, least: np.ndarray, under: np.ndarray) -> DataFrame:
    """``(q, key, bound)``: for each item the texts with the largest bounds from ``least`` up and below ``under``, of every task."""
    limits = sketches.sparkSession.sparkContext.broadcast((least, under))

    def run(batches):
        own = queries.value
        best = Best(len(own.weights), portion, *limits.value)
        rows = max(1, HELD // len(own.weights))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                cut = batch.slice(at, rows)
                keys = np.frombuffer(b"".join(cut.column("key").to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
                best.add(own.bounds(cut.column("n").to_numpy(), cut.column("sketch").to_pylist()), keys)
        best.settle()
        q, b, k = best.held
        raw = k.astype(">u8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary()), pa.array(b.astype(np.int64))], ["q", "key", "bound"])

    return sketches.select("key", "n", "sketch").mapInArrow(run, "q int, key binary, bound long").dropDuplicates(["q", "key"])


def _rows_with(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """``rows`` joined with ``keys``, which hold each key once; ``n`` of them, broadcast if they are few."""
    return rows.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, "key")


def _exact_scores(docs: DataFrame, wanted: DataFrame, queries) -> DataFrame:
    """``(q, key, score)`` for the ``(q, key)`` rows of ``wanted``, from the texts."""

    def run(batches):
        own, seen = queries.value, set()
        for batch in batches:
            for cut in slices(batch):
                out = []
                for key, text, items in zip(*(cut.column(c).to_pylist() for c in ("key", "text", "items")), strict=True):
                    if key in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(key)
                    tf = Counter(terms(text))
                    m = own.length(tf.total())
                    out += [(q, key, own.score(q, tf, m)) for q in items]
                columns = list(zip(*out, strict=True)) if out else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], ["q", "key", "score"])

    keys = materialise(wanted.groupBy("key").agg(F.collect_list("q").alias("items")), "wanted")
    return _rows_with(docs, keys, keys.count()).select("key", "text", "items").mapInArrow(run, "q int, key binary, score long").dropDuplicates(["q", "key"])


def _best_texts(sketches: DataFrame, docs: DataFrame, queries, items: int, k: int) -> DataFrame:
    """``(q, key, score)``: for each item the k texts with the highest scores over 0, and all that tie with the last."""
    least, under = np.ones(items), np.full(items, np.inf)
    found, portion = None, max(PORTION, k)
    while True:
        largest = materialise(_largest_bounds(sketches, queries, portion, least, under), "bounds")
        place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("bound")))
        ends = largest.withColumn("r", place).filter(F.col("r") <= portion).groupBy("q").agg(F.count("*").alias("n"), F.min("bound").alias("least")).collect()  # a row for each item of the block
        if not ends:
            break
        cut = least.copy()
        under = least.copy()  # items without a text here are done
        for r in ends:
            if r["n"] == portion:
                cut[r["q"]] = under[r["q"]] = r["least"]
        cuts = docs.sparkSession.createDataFrame([(r["q"], int(cut[r["q"]])) for r in ends], "q int, cut long")
        wanted = largest.join(F.broadcast(cuts), "q").filter(F.col("bound") >= F.col("cut")).select("q", "key")
        scores = _exact_scores(docs, wanted, queries).filter("score > 0")
        both = scores if found is None else found.unionByName(scores)
        rank = F.rank().over(W.partitionBy("q").orderBy(F.desc("score")))
        found = materialise(both.withColumn("r", rank).filter(F.col("r") <= k).drop("r"), "scores")
        for r in found.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect():
            if r["n"] >= k:
                least[r["q"]] = max(least[r["q"]], r["least"])
        if (under <= least).all():
            break
        portion *= GROWTH
    return found if found is not None else docs.sparkSession.createDataFrame([], "q int, key binary, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k documents with the highest scores over 0, exactly.

    A term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))`` and adds its weight times its
    ``impact`` for each time it stands in the item. Equal scores go by id, null ids last.
    Null and empty texts have no terms: such documents are never found, such items have
    no rows, and neither have items none of whose terms occur. Rows of documents count
    one by one, equal or not; equal rows of items are one item, rows with one id and
    different texts are items of their own. Empty tables give no rows.
    """
    spark = docs.sparkSession
    sketches, frequencies = build_index(docs, items, id_col, text_col, item_text, width)
    size = sketches.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    weight = F.floor(1000 * F.log((2.0 * size["n"] + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = materialise(item_terms(items, item_id, item_text).join(frequencies, "term").withColumn("w", weight * F.col("times")).select("item", "item_id", "term", "w"), "terms")
    blocks = max(1, -(-weighed.count() // BLOCK_TERMS))
    texts = docs.select(_text_key(whole_text(docs, text_col)).alias("key"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = weighed.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "item_id", "term").collect()
        names = list(dict.fromkeys((r["item"], r["item_id"]) for r in own))
        if not names:
            continue
        number = {name: q for q, name in enumerate(names)}
        weights: list[dict[bytes, int]] = [{} for _ in names]
        for r in own:
            weights[number[r["item"], r["item_id"]]][r["term"].encode()] = r["w"]
        queries = spark.sparkContext.broadcast(Queries.of(weights, size["n"], size["total"], width))
        best = _best_texts(sketches, texts, queries, len(names), k)
        keys = materialise(best.select("key").distinct(), "keys")
        copies = W.partitionBy("key").orderBy(F.asc_nulls_last("doc_id"))
        holders = _rows_with(sketches.select("key", "doc_id"), keys, keys.count()).withColumn("r", F.row_number().over(copies)).filter(F.col("r") <= k).drop("r")
        order = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = best.join(holders, "key").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(q, i) for q, (_, i) in enumerate(names)], "q int, item_id long")
        out = out.unionByName(ranked.join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score"))
    return out


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents for every item of the benchmark."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
