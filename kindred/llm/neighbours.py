"""Approximate nearest neighbours through a permutation index.

A vector is represented by its nearest pivots in order. Each block of the collection
posts its vectors in inverted files, one for each pivot, with the pivot's place in the
vector's order. A query reads the files of its own nearest pivots and adds up, for each
vector met, how much nearer the two orders are than strangers: with places from 0 and
``prefix`` for an absent pivot, Spearman's footrule falls by ``2 (prefix - max(place,
place))`` for each shared pivot. The best share of a block by footrule is reranked by
the exact cosine of the original vectors.

The pivots are a bounded sample of the block itself; every row is indexed. Vectors are
dealt into blocks of bounded size by a hash and move once. A block's index is built once,
then the queries stream past it, and only each query's best few from every block move on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kindred.llm.common import partitions, table
from kindred.plans.joins import join_counted
from kindred.plans.storage import materialise

#: Distinct vectors of a block that are its pivots, those with the smallest hashes.
PIVOTS = 128
PREFIX = 48
#: Share of a block that is reranked for a query, and the fewest vectors that are.
SHARE, LEAST = 0.35, 256
BLOCK_ROWS = 16_384


def usable(vector: Column) -> Column:
    """True for vectors that take part: not null or zero, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to between a half and one.

    That is exact and changes no cosine, and squares neither overflow nor vanish.
    """
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def orders(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each unit vector, nearest first, ties to the earlier pivot."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix]


class BlockIndex:
    """The pivot inverted files of one block. Equal vectors are posted once, with all their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: int = PIVOTS, prefix: int = PREFIX) -> None:
        self.vectors, group = np.unique(vectors, axis=0, return_inverse=True)
        by_group = np.lexsort((ids, group))
        self.ids = ids[by_group]
        self.starts = np.searchsorted(group[by_group], np.arange(len(self.vectors) + 1))
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        unit = self.vectors / self.norms[:, None]
        hashes = [xxhash.xxh3_64_intdigest(v.tobytes()) for v in self.vectors]
        self.pivots = unit[np.argsort(np.array(hashes, np.uint64), kind="stable")[:pivots]]
        self.prefix = min(prefix, len(self.pivots))
        flat = orders(unit, self.pivots, self.prefix).ravel()
        at = np.argsort(flat, kind="stable")
        self.rows = at // self.prefix
        self.places = (at % self.prefix).astype(np.int32)
        self.first = np.searchsorted(flat[at], np.arange(len(self.pivots) + 1))

    def search(self, own: int, vector: np.ndarray, k: int, share: float = SHARE, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the best ``k`` rows with another id, nearest first, ties to the smaller id."""
        n, norm = len(self.vectors), np.sqrt((vector * vector).sum())
        nearer = np.zeros(n, np.int64)
        for place, pivot in enumerate(orders(vector[None] / norm, self.pivots, self.prefix)[0]):
            files = slice(self.first[pivot], self.first[pivot + 1])
            nearer[self.rows[files]] += self.prefix - np.maximum(place, self.places[files])
        taken = min(n, max(least, ceil(share * n)))
        chosen = np.argpartition(-(nearer * n - np.arange(n)), taken - 1)[:taken]
        cosine = (self.vectors[chosen] * vector).sum(axis=1) / (self.norms[chosen] * norm)
        # The groups of the best k + 1 values hold the best k ids, the query's own aside.
        if taken > k + 1:
            near = cosine >= np.partition(cosine, taken - k - 1)[taken - k - 1]
            chosen, cosine = chosen[near], cosine[near]
        heads = [self.ids[self.starts[g] : min(self.starts[g + 1], self.starts[g] + self._slack(g, own, k))] for g in chosen]
        ids = np.concatenate(heads) if heads else np.zeros(0, np.int64)
        scores = np.repeat(cosine, [len(h) for h in heads])
        ids, scores = ids[ids != own], scores[ids != own]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]

    def _slack(self, group: int, own: int, k: int) -> int:
        """How many of a group's ids to look at so that ``k`` are not the query's own."""
        ids = self.ids[self.starts[group] : self.starts[group + 1]]
        return k + int(np.searchsorted(ids, own, side="right") - np.searchsorted(ids, own))


def search(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where ``is_query``, its ``k`` nearest other rows found.

    Vectors that ``usable`` excludes and rows with a null id take no part; vectors of
    different lengths aren't neighbours, so each length is searched on its own. Rows with
    the query's own id aren't its neighbours; rows repeated under another id are, each on
    its own. Repeats of one query are answered once; a query's id with several different
    vectors gets the neighbours of each, told apart by their ranks only in that they start
    anew. Fewer candidates than ``k`` give
    fewer rows; an empty table none.
    """
    spark = rows.sparkSession
    valid = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"), is_query.alias("is_query"))
    valid = valid.filter(usable(F.col("vector"))).filter("vec_id is not null").withColumn("size", F.size("vector"))
    lengths = materialise(valid.groupBy("size").agg(F.count("*").alias("n")), "lengths")
    total = lengths.agg(F.sum("n")).first()[0] or 0
    blocks = lengths.select("size", "n", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    sized = join_counted(valid, blocks, ["size"], total)
    h = F.xxhash64("vector")
    dealt = sized.select("size", F.pmod(F.xxhash64("vec_id", "vector"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "vec_id", "vector", F.lit(0).cast("long").alias("h"))
    queries = sized.filter("is_query").select("size", "blocks", "vec_id", "vector").distinct()
    queries = queries.select("size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "vec_id", "vector", h.alias("h"))
    both = dealt.unionByName(queries).repartition(partitions(spark), "size", "block").sortWithinPartitions("size", "block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, vectors, index = None, [], [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("size", "block", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(key)]
            for lo, hi in pairwise(cuts):
                if lo == hi:
                    continue
                size, block, side = key[lo].tolist()
                part = batch.slice(lo, hi - lo)
                mine, matrix = part.column("vec_id").to_numpy(), scaled(part.column("vector").flatten().to_numpy().reshape(-1, size))
                if (size, block) != own:
                    own, ids, vectors, index = (size, block), [], [], None
                if side == 0:
                    ids.append(mine)
                    vectors.append(matrix)
                    continue
                if index is None:  # the block's rows came first
                    index = BlockIndex(np.concatenate(ids), np.concatenate(vectors), pivots, prefix)
                    ids, vectors = [], []
                out = [(q, x, int(i), float(s)) for q, x, v in zip(mine.tolist(), part.column("h").to_pylist(), matrix, strict=True) for i, s in zip(*index.search(q, v, k, share, least), strict=True)]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "query_hash", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, query_hash long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest rows to every fiftieth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
