"""Similarity self-joins: Hamming, cosine, keyframe sets, local descriptors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations, groupby
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import IntegralType

from kindred.functions.scalars import hamming, l2_normalise
from kindred.operators import tiles
from kindred.plans.joins import TILE_ROWS, deal_tiled, join_counted, join_tiled
from kindred.plans.storage import materialise

BITS = 64
#: What a shuffled probe and a comparison of two hashes cost, relative to each other.
PROBE_COST, COMPARE_COST = 1.0, 0.001
#: The cost that one task gets, at most: a few seconds.
TASK_COST = 3_000_000
#: Where all hashes of a scope meet: slices that they are dealt into at least, and rows of a slice that are enough.
SLICES, LEAST_SLICE = 16, 512
#: Pairs of hashes that are compared at once, and pairs of a key from which on it is compared on its own.
AT_ONCE, LARGE = 1 << 18, 2048
#: Where all files of a scope meet: files of a slice at most, and pairs of hashes and edges that are handled at once, about.
MEET_ROWS, MEET_AT_ONCE, EDGES_AT_ONCE = 1 << 17, 1 << 18, 1 << 17
#: Files of one hash up to which edges are made file by file, without counting places.
FEW_FILES = 4
#: Probes of one hash, at most.
MAX_PROBES = 20_000
BLOCK_ROWS = tiles.BLOCK_ROWS
#: Pivots by which blocks of vectors are told apart.
PIVOTS = 16
#: So many blocks of keypoints are made, until one has so many rows; and the pairs of keypoints that one task compares, about.
FILE_BLOCKS, MAX_BLOCK_ROWS, TASK_PAIRS = 24, 16_384, 1 << 30
#: Of large tables so many blocks of vectors are made, until a block has so many numbers.
BLOCKS, BLOCK_NUMBERS = 24, 1 << 22
#: Vectors of two blocks that are multiplied at once, pairs that are checked at once, and tasks that the pairs of blocks are dealt to, at most.
LEFT_ROWS, RIGHT_ROWS, CHECKED_ROWS, MOST_TASKS = 256, 1024, 1 << 14, 2048
#: What a bound of two vectors costs in nanoseconds, in all and for each of its numbers, and what each number costs where the pair is checked.
BOUND_COST, NUMBER_COST, CHECK_COST = 1.0, 0.03, 2.0


@dataclass(frozen=True)
class Band:
    """Some bits of a hash, and in how many of them two near hashes may differ."""

    bits: tuple[int, ...]
    flips: int

    @property
    def mask(self) -> int:
        """The band's bits as a signed 64-bit number."""
        m = sum(1 << b for b in self.bits)
        return m - (1 << 64) if m >> 63 else m

    def value(self, h: Column) -> Column:
        """The band's bits next to each other; bits in a row move together."""
        out, at = F.lit(0).cast("long"), 0
        for _, run in groupby(enumerate(self.bits), lambda x: x[1] - x[0]):
            own = [b for _, b in run]
            part = F.shiftrightunsigned(h, own[0])
            if len(own) < BITS:
                part = part.bitwiseAND((1 << len(own)) - 1)
            out, at = out.bitwiseOR(F.shiftleft(part, at)), at + len(own)
        return out

    @property
    def probes(self) -> int:
        """The number of ``masks``."""
        return sum(comb(len(self.bits), f) for f in range(self.flips + 1))

    def masks(self) -> list[int]:
        w = len(self.bits)
        found = [sum(1 << b for b in at) for n in range(self.flips + 1) for at in combinations(range(w), n)]
        return [m - (1 << 64) if m >> 63 else m for m in found]


def _told(n: int, ones: list[int] | None) -> list[float]:
    """The information in each bit of ``n`` hashes."""
    share = [min(max((k + 0.5) / (n + 1), 1e-9), 1 - 1e-9) for k in (ones or [n // 2] * BITS)]
    return [-p * log2(p) - (1 - p) * log2(1 - p) for p in share]


def _cost(bands: list[Band], n: int, told: list[float]) -> float:
    """What a hash costs to probe and to compare, among ``n``."""
    return sum(b.probes * (PROBE_COST + COMPARE_COST * n / 2 ** sum(told[x] for x in b.bits)) for b in bands)


def plan_bands(threshold: int, n: int, ones: list[int] | None = None) -> list[Band]:
    """Bands for ``n`` hashes: two hashes within ``threshold`` bits agree, up to a band's flips, in one of them.

    If the flips of m bands and one for each band come to more than the threshold, not
    all bands can differ more. Bits are dealt so that bands hold equally much
    information (``ones``: how often each bit is set), so a bit that hardly varies makes
    no band coarse; the number of bands is the one for which probing and comparing cost
    least.
    """
    told = _told(n, ones)
    even = min(told) > 0.5
    best: tuple[float, list[Band]] | None = None
    for m in range(1, min(threshold + 1, BITS) + 1):
        if even:
            ends = [BITS * k // m for k in range(m + 1)]
            groups = [list(range(a, b)) for a, b in zip(ends, ends[1:], strict=False)]
        else:
            groups = [[] for _ in range(m)]
            for b in sorted(range(BITS), key=lambda b: -told[b]):
                min(groups, key=lambda g: (sum(told[x] for x in g), len(g))).append(b)
        base, more = divmod(threshold + 1, m)
        groups.sort(key=lambda g: -sum(told[b] for b in g))
        bands = [Band(tuple(sorted(g)), base - 1 + (k < more)) for k, g in enumerate(groups)]
        probes = sum(b.probes for b in bands)
        if probes > MAX_PROBES and best is not None:
            continue
        cost = _cost(bands, n, told)
        if best is None or cost < best[0] or sum(b.probes for b in best[1]) > MAX_PROBES:
            best = cost, bands
    return best[1]


def _plan(threshold: int, n: int, ones: list[int] | None, fresh: int | None, slice_rows: int) -> tuple[list[Band], float]:
    """The cheaper of planned bands and one without bits, in which all hashes of a scope meet; and the cost of all probing hashes.

    Wide thresholds rule hardly any pair out, so there every pair is compared, once.
    """
    own, told = n if fresh is None else fresh, _told(n, ones)
    bands = plan_bands(threshold, n, ones)
    banded, whole = _cost(bands, n, told), _cost([Band((), threshold)], n, told) + 2 * PROBE_COST * n / slice_rows
    return (bands, own * banded) if banded <= whole else ([Band((), threshold)], own * whole)


def _bits_of(threshold: int) -> int:
    return max(0, min(threshold, BITS))


def _near(h: np.ndarray, starts: np.ndarray, mids: np.ndarray, ends: np.ndarray, threshold: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places i, j in ``h`` of probes and hashes within ``threshold`` bits.

    Each key has its hashes from ``starts`` and its probes from ``mids`` on. With ``once``
    only pairs with the smaller number on the probe's side count.
    """
    bits, homes, probes = h.view(np.uint64), mids - starts, ends - mids
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.flatnonzero(homes * probes > LARGE):
        y, x = starts[g] + np.argsort(h[starts[g] : mids[g]]), mids[g] + np.argsort(h[mids[g] : ends[g]])
        step = max(1, AT_ONCE // len(y))
        for lo in range(0, len(x), step):
            own = x[lo : lo + step]
            rest = y[np.searchsorted(h[y], h[own[0]], side="right") :] if once else y
            if len(rest):
                found = np.flatnonzero(np.bitwise_count(bits[own][:, None] ^ bits[rest]) <= threshold)
                left.append(own[found // len(rest)])
                right.append(rest[found % len(rest)])
    few = np.flatnonzero((homes * probes > 0) & (homes * probes <= LARGE))
    x = np.repeat(mids[few] - np.cumsum(probes[few]) + probes[few], probes[few]) + np.arange(probes[few].sum())
    n, first = np.repeat(homes[few], probes[few]), np.repeat(starts[few], probes[few])
    total, lo = np.cumsum(n), 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, side="right")))
        size = n[lo:hi]
        i = np.repeat(x[lo:hi], size)
        j = np.repeat(first[lo:hi] - np.cumsum(size) + size, size) + np.arange(len(i))
        near = np.bitwise_count(bits[i] ^ bits[j]) <= threshold
        left.append(i[near])
        right.append(j[near])
        lo = hi
    i, j = np.concatenate(left), np.concatenate(right)
    kept = h[i] < h[j] if once else h[i] != h[j]
    return i[kept], j[kept]


def _meet(probes: DataFrame, homes: DataFrame, threshold: int, tasks: int, tile_rows: int, once: bool) -> DataFrame:
    """``(s, band, x, y, dist)`` for rows ``s, band, value, h`` of both sides that share all but ``h`` and are within ``threshold``.

    Rows come sorted by key, a key's hashes before its probes, so a task holds the hashes
    of one key (``tile_rows``) and compares them with a batch of probes at once. Keys are
    hashed: bands and scopes are compared again, and the caller checks the bands' bits.
    """
    left, right = deal_tiled(probes, homes, ["s", "band", "value"], tile_rows)
    key = F.xxhash64("s", "band", "value", "__l", "__r").bitwiseAND(-2)
    rows = left.select(key.bitwiseOR(1).alias("key"), "s", "band", "h").unionByName(right.select(key.alias("key"), "s", "band", "h"))
    rows = rows.repartition(tasks, F.col("key").bitwiseAND(-2)).sortWithinPartitions("key")

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            key, band, h = (t.column(c).to_numpy() for c in ("key", "band", "h"))
            starts = np.flatnonzero(np.append(True, key[1:] >> 1 != key[:-1] >> 1))
            ends = np.append(starts[1:], len(key))
            mids = starts + np.add.reduceat(1 - (key & 1), starts)
            i, j = _near(h, starts, mids, ends, threshold, once)
            s = t.column("s")
            same = (band[i] == band[j]) & np.asarray(pc.equal(s.take(pa.array(i)), s.take(pa.array(j))), bool)
            i, j = i[same], j[same]
            dist = np.bitwise_count(h[i].view(np.uint64) ^ h[j].view(np.uint64)).astype(np.int32)
            found = pa.table({"s": s.take(pa.array(i)), "band": band[i], "x": h[i], "y": h[j], "dist": dist})
            yield from found.combine_chunks().to_batches()
            held = t.slice(starts[-1], mids[-1] - starts[-1])

    return rows.mapInArrow(run, "s string, band int, x long, y long, dist int")


def _distinct(rows: DataFrame, scope: str, column: str) -> DataFrame:
    """``(s, h)``: the distinct hashes of each scope, dealt to all tasks (of small tables one task would make all probes)."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(rows.filter(F.col(column).isNotNull()).select(scope_key(F.col(scope)).alias("s"), F.col(column).alias("h")).distinct().repartition(tasks, "s", "h"), "distinct")


def _slice_rows(n: int, most: int) -> int:
    return min(most, max(LEAST_SLICE, n // SLICES))


def hamming_pairs(hashes: DataFrame, threshold: int, scope: str = "scope", column: str = "h", fresh: DataFrame | None = None, bands: list[Band] | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``(scope, x, y, dist)``: distinct hashes x < y of one scope within ``threshold`` bits.

    Multi-index hashing: one side probes every value near enough of every band, and both
    meet by value; values that very many hashes share are dealt into tiles
    (``deal_tiled``), and the number of tasks follows the planned work. Where bands would
    cost more than that, all hashes of a scope meet. A pair comes out of its first
    fitting band only. With ``fresh`` (rows with the same columns) only pairs with a hash
    of those are looked for, and only they probe. ``bands`` replaces the planned ones.
    """
    threshold = _bits_of(threshold)
    distinct = _distinct(hashes, scope, column)
    probing = distinct if fresh is None else _distinct(fresh, scope, column)
    n, ones = distinct.agg(F.count("*"), _ones(F.col("h"))).first()
    own = n if fresh is None else probing.count()
    if bands is None:
        bands, cost = _plan(threshold, n, ones if n else None, own, _slice_rows(n, tile_rows))
    else:
        cost = own * _cost(bands, n, _told(n, ones if n else None))
    found = _banded(distinct, probing, threshold, bands, cost, tile_rows if bands[0].bits else _slice_rows(n, tile_rows), fresh is None)
    return found if fresh is None else found.distinct()


def _banded(distinct: DataFrame, probing: DataFrame, threshold: int, bands: list[Band], cost: float, tile_rows: int, once: bool) -> DataFrame:
    """The pairs of ``hamming_pairs`` by the given bands, which cost so much in all."""
    spark = distinct.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(cost / TASK_COST))
    band = F.posexplode(F.array(*[b.value(F.col("h")) for b in bands])).alias("band", "value")
    masks = spark.createDataFrame([(k, m) for k, b in enumerate(bands) for m in b.masks()], "band int, mask long")  # MAX_PROBES rows at most
    probes = probing.repartition(tasks).select("s", "h", band).join(F.broadcast(masks), "band")
    probes = probes.select("s", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"), "h")
    met = _meet(probes, distinct.select("s", band, "h"), threshold, tasks, tile_rows, once)
    differ, first = F.col("x").bitwiseXOR(F.col("y")), F.lit(True)
    for k, b in enumerate(bands):
        apart = F.bit_count(differ.bitwiseAND(F.lit(b.mask)))
        first = first & F.when(F.col("band") > k, apart > b.flips).when(F.col("band") == k, apart <= b.flips).otherwise(True)
    return met.filter(first).select(F.when(F.col("s") != "", F.substring("s", 2, 1 << 30)).alias("scope"), F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "dist")


def _places(near: np.ndarray, n: int) -> np.ndarray:
    """Where the first ``n`` of a mask (its length a multiple of 8) are set: by words of eight first, as few are."""
    words = np.flatnonzero(near[: -(-n // 8) * 8].view(np.uint64) != 0)
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return at[near[at]]


def _met(x: np.ndarray, y: np.ndarray, threshold: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j of hashes of ``x`` and ``y`` within ``threshold`` bits and their distance, part by part; i <= j if both are the ``same``."""
    x, y = x.view(np.uint64), y.view(np.uint64)
    step = max(1, MEET_AT_ONCE // max(1, len(y)))
    room = -(-step * len(y) // 8) * 8
    differ, bits, near = np.empty(room, np.uint64), np.empty(room, np.uint8), np.zeros(room, bool)
    for lo in range(0, len(x), step):
        own, rest = x[lo : lo + step], y[lo:] if same else y
        n = len(own) * len(rest)
        np.bitwise_xor(own[:, None], rest, out=differ[:n].reshape(len(own), -1))
        np.less_equal(np.bitwise_count(differ[:n], out=bits[:n]), threshold, out=near[:n])
        near[n : n + 8] = False
        at = _places(near, n)
        i, dist = at // max(1, len(rest)), bits[at]
        j = at - i * len(rest) + (lo if same else 0)
        i += lo
        yield (i[i <= j], j[i <= j], dist[i <= j]) if same else (i, j, dist)


def _edges_of_tile(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(a, b, dist)``, part by part, for files ``h, o, kind`` of two slices, or of one: different hashes are compared once."""
    same, sides = b is None, []
    for h, o, kind in [a] if b is None else [a, b]:
        order = np.argsort(h, kind="stable")
        values, first, n = np.unique(h[order], return_index=True, return_counts=True)
        sides.append((values, first, n, o[order], kind[order]))
    (x, fx, nx, ox, kx), (y, fy, ny, oy, ky) = sides[0], sides[-1]
    copies = same or bool(np.isin(kx, ky).any())
    # The n-th file of each hash and its digest, or the last.
    nth_x, nth_y = ([(o[at], kind[at]) for at in (first + np.minimum(k, n - 1) for k in range(min(FEW_FILES, n.max(initial=0))))] for _, first, n, o, kind in (sides[0], sides[-1]))

    def few(i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Edges of different hashes with few files, made for the n-th and m-th files of all pairs at once."""
        for k, (o, kind) in enumerate(nth_x):
            if k:
                kept = nx[i] > k
                i, j, dist = i[kept], j[kept], dist[kept]
            i_k, j_k, d_k = i, j, dist
            for m, (p, other) in enumerate(nth_y):
                if m:
                    kept = ny[j_k] > m
                    i_k, j_k, d_k = i_k[kept], j_k[kept], d_k[kept]
                a, b, d = o[i_k], p[j_k], d_k
                if copies:
                    kept = (kind[i_k] < 0) | (kind[i_k] != other[j_k])
                    a, b, d = a[kept], b[kept], d[kept]
                if len(a):
                    yield np.minimum(a, b), np.maximum(a, b), d

    def many(i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Edges of any two hashes, or one, a bounded number at a time."""
        wide = ny[j]
        ends = np.cumsum(nx[i] * wide)
        starts = ends - nx[i] * wide
        for lo in range(0, int(ends[-1]) if len(ends) else 0, EDGES_AT_ONCE):
            hi = min(lo + EDGES_AT_ONCE, int(ends[-1]))
            p, q = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi - 1, side="right") + 1
            pair = np.repeat(np.arange(p, q), np.minimum(ends[p:q], hi) - np.maximum(starts[p:q], lo))
            nth = np.arange(lo, hi) - starts[pair]
            u, v = fx[i[pair]] + nth // wide[pair], fy[j[pair]] + nth % wide[pair]
            kept = ((kx[u] < 0) | (kx[u] != ky[v])) & ((dist[pair] > 0) | ((ox[u] != oy[v]) & ((u < v) | (not same))))
            u, v = ox[u[kept]], oy[v[kept]]
            yield np.minimum(u, v), np.maximum(u, v), dist[pair[kept]]

    def made(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        found = [np.concatenate(c) for c in zip(*held, strict=True)]
        large = (found[2] == 0) | (nx[found[0]] > FEW_FILES) | (ny[found[1]] > FEW_FILES)
        yield from few(*[c[~large] for c in found] if large.any() else found)
        yield from many(*[c[large] for c in found])

    held, n = [], 0
    for found in _met(x, y, threshold, same):
        held.append(found)
        n += len(found[0])
        if n >= EDGES_AT_ONCE:
            yield from made(held)
            held, n = [], 0
    if held:
        yield from made(held)


def _all_meet(rows: DataFrame, threshold: int, exclude_exact: bool, most: int = MEET_ROWS) -> DataFrame:
    """The edges of ``hamming_edges`` among ``rows`` (``s, ord, md5, h``) where all hashes of a scope meet.

    Files are dealt into slices by hash, those of a very common hash by number, and every
    two slices of a scope meet in one task, which makes the edges: no edge is shuffled,
    and a file moves once for each slice. A task holds two slices and a part of its edges.
    """
    spark = rows.sparkSession
    rows = materialise(rows, "rows")
    tasks, total = int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count()
    slice_rows = _slice_rows(total, most)
    if exclude_exact:  # digests as numbers, null as one, too
        kinds = rows.groupBy("md5").agg(F.count("*").alias("n")).filter("md5 is not null").withColumn("kind", F.monotonically_increasing_id() + 1)
        known = join_counted(rows, materialise(kinds, "kinds"), ["md5"], total)
        rows = known.select("s", "h", "ord", "kind").unionByName(rows.filter("md5 is null").select("s", "h", "ord", F.lit(0).cast("long").alias("kind")))
    else:
        rows = rows.select("s", "h", "ord", F.lit(-1).cast("long").alias("kind"))
    rows = materialise(rows.select("s", "h", F.col("ord").cast("long").alias("o"), "kind"), "files")
    large = materialise(rows.groupBy("s").agg(F.count("*").alias("n")).filter(F.col("n") > slice_rows).select("s", F.ceil(F.col("n") / slice_rows).cast("int").alias("k")), "large")
    hot = materialise(rows.groupBy("s", "h").agg(F.count("*").alias("n")).filter(F.col("n") > slice_rows // 8).select("s", "h", F.lit(True).alias("hot")), "hot")
    tasks += large.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") + 1) / 2), F.lit(0)).cast("long")).first()[0]
    sized = rows.join(F.broadcast(large), "s", "left").join(F.broadcast(hot), ["s", "h"], "left").withColumn("k", F.coalesce("k", F.lit(1)))  # both tables are bounded by the number of slices
    own = F.pmod(F.xxhash64("h", F.when(F.col("hot"), F.col("o"))), F.col("k")).cast("int")
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("s", i.alias("i"), j.alias("j"), (F.col("own") > F.col("other")).alias("right"), "h", "o", "kind")
    task = F.pmod(F.pmod(F.xxhash64("s"), F.lit(tasks)) + F.expr("j * (j + 1L) div 2 + i"), F.lit(tasks)).cast("int")
    dealt = dealt.repartitionById(tasks, task).sortWithinPartitions("i", "j", "s")

    def run(batches):
        def edges(parts):
            t = pa.Table.from_batches(parts)
            right, cols = t.column("right").to_numpy(), [t.column(c).to_numpy() for c in ("h", "o", "kind")]
            alone = t.column("i")[0].equals(t.column("j")[0])
            sides = [[c[~right] for c in cols], None if alone else [c[right] for c in cols]]
            for a, b, dist in _edges_of_tile(*sides, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(dist.astype(np.int32))], ["a", "b", "dist"])

        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows - 1, bool)
            for c in ("s", "i", "j"):
                changed |= np.asarray(pc.not_equal(batch.column(c)[1:], batch.column(c)[:-1]), bool)
            starts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(starts, starts[1:], strict=False):
                key = tuple(batch.column(c)[lo].as_py() for c in ("s", "i", "j"))
                if held and key != last:
                    yield from edges(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last = key
        if held:
            yield from edges(held)

    return dealt.mapInArrow(run, "a long, b long, dist int")


def _of_files(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, ma, mb, dist)``, a < b by ``ord``: rows ``scope, ord, md5, h`` of one hash, and of the given ``pairs`` of hashes."""
    a = rows.select("scope", F.col("ord").alias("a"), F.col("md5").alias("ma"), F.col("h").alias("x"))
    b = rows.select(F.col("scope").alias("sb"), F.col("ord").alias("b"), F.col("md5").alias("mb"), F.col("h").alias("y"))
    same = a.join(b, a["scope"].eqNullSafe(b["sb"]) & (F.col("x") == F.col("y")) & (F.col("a") < F.col("b"))).select("a", "b", "ma", "mb", F.lit(0).alias("dist"))
    p = pairs.select(F.col("scope").alias("ps"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("dist"))
    near = a.join(p, a["scope"].eqNullSafe(p["ps"]) & (F.col("x") == F.col("px"))).select("a", "ma", "ps", "py", "dist")
    near = near.join(b, near["ps"].eqNullSafe(b["sb"]) & (F.col("py") == F.col("y"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ma", "mb", "dist")
    return same.unionByName(near)


def edges_of_files(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, dist)`` of all files, copies by md5 left out, from the near ``pairs`` (``scope, x, y, dist``) of their hashes."""
    return _of_files(rows.filter("h is not null"), pairs).filter("not (ma <=> mb)").select("a", "b", "dist")


def hamming_edges(hashes: DataFrame, threshold: int = 10, column: str = "h", exclude_exact: bool = True, fresh: DataFrame | None = None) -> DataFrame:
    """``(a, b, dist)``, a < b by ``ord``: rows of one scope within ``threshold`` bits, copies by md5 left out.

    ``hashes``: ``scope, ord, md5`` and the hash column. Equal hashes join by equality;
    different ones through the pairs of ``hamming_pairs`` over distinct values. Where all
    hashes of a scope meet, edges are made where they are found (``_all_meet``). ``fresh``
    are rows of the same table; if given, only edges with one of them come back.
    """
    rows = hashes.select(F.col("scope").cast("string").alias("scope"), "ord", "md5", F.col(column).alias("h")).filter("h is not null")
    if fresh is None:
        threshold, distinct = _bits_of(threshold), _distinct(hashes, "scope", column)
        n, ones = distinct.agg(F.count("*"), _ones(F.col("h"))).first()
        bands, cost = _plan(threshold, n, ones if n else None, n, _slice_rows(n, TILE_ROWS))
        if not bands[0].bits and isinstance(rows.schema["ord"].dataType, IntegralType):
            met = _all_meet(rows.filter("ord is not null").select(scope_key(F.col("scope")).alias("s"), "ord", "md5", "h"), threshold, exclude_exact)
            return met.select(*[F.col(c).cast(rows.schema["ord"].dataType) for c in "ab"], "dist")
        out = _of_files(rows, _banded(distinct, distinct, threshold, bands, cost, TILE_ROWS if bands[0].bits else _slice_rows(n, TILE_ROWS), True))
    else:
        out = _of_files(rows, hamming_pairs(hashes, threshold, column=column, fresh=fresh))
        new = fresh.select(F.col("ord").alias("__n")).distinct()
        out = out.join(new, F.col("a") == F.col("__n"), "left_semi").unionByName(out.join(new, F.col("b") == F.col("__n"), "left_semi")).distinct()
    return (out.filter("not (ma <=> mb)") if exclude_exact else out).select("a", "b", "dist")


def _ones(column: Column) -> Column:
    """How often each of the 64 bits is set, over a group."""
    return F.array(*[F.sum(F.shiftrightunsigned(column, bit).bitwiseAND(1)) for bit in range(64)])


def _within(n: Column, ones: Column) -> Column:
    """Differing bits summed over all pairs of a group: each bit gives ones times zeros."""
    return F.aggregate(ones, F.lit(0).cast("long"), lambda total, k: total + k * (n - k))


def _across(n: Column, ones: Column, m: Column, others: Column) -> Column:
    """Differing bits summed over all pairs between two groups."""
    return F.aggregate(F.zip_with(ones, others, lambda k, j: k * (m - j) + (n - k) * j), F.lit(0).cast("long"), lambda total, x: total + x)


def scope_key(scope: Column) -> Column:
    """The scope as a key that is never null; the pool's is empty."""
    return F.coalesce(F.concat(F.lit("s"), scope.cast("string")), F.lit(""))


def hash_nodes(hashes: DataFrame, exclude_exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(classes, nodes)`` of ``scope, ord, md5, h, tp`` rows: copies of one file, and all files of one hash, as one row each.

    An absent top hash counts as the full one. Both tables have ``s, h, first, n, ones``;
    classes also ``kind`` (the digest), nodes ``own_n`` and ``own_top``, the pairs within
    classes and their differing bits, which don't count as edges.
    """
    kind = F.coalesce(F.concat(F.lit("m"), "md5"), F.lit("")) if exclude_exact else F.lit("")
    rows = hashes.filter("h is not null").select(scope_key(F.col("scope")).alias("s"), "h", kind.alias("kind"), "ord", F.coalesce("tp", "h").alias("tp"))
    classes = materialise(rows.groupBy("s", "h", "kind").agg(F.min("ord").alias("first"), F.count("*").alias("n"), _ones(F.col("tp")).alias("ones")), "classes")
    one = classes.select("s", "h", F.col("first").alias("f"), F.col("n").alias("k"), F.col("ones").alias("o"), _within(F.col("n"), F.col("ones")).alias("top"))
    own = [F.sum(F.col("k") * (F.col("k") - 1) / 2).cast("long"), F.sum("top")] if exclude_exact else [F.lit(0).cast("long")] * 2
    every = F.array(*[F.sum(F.col("o")[bit]) for bit in range(64)])
    nodes = one.groupBy("s", "h").agg(F.min("f").alias("first"), F.sum("k").alias("n"), every.alias("ones"), own[0].alias("own_n"), own[1].alias("own_top"))
    return classes, materialise(nodes, "nodes")


def edge_sums(classes: DataFrame, nodes: DataFrame, threshold: int = 10, exclude_exact: bool = True) -> DataFrame:
    """``(a, b, dist, dist_top, n)``: the edges of ``hamming_edges`` added up for each pair of distinct hashes.

    ``a`` and ``b`` are the first files with the two hashes (or one hash: a = b). The
    number of edges between two hashes and the sum of their top distances follow from
    counts of files and of bits, so a hash that very many files share costs one row.
    """
    pairs = materialise(hamming_pairs(nodes.select(F.col("s").alias("scope"), "h"), threshold).select(F.col("scope").alias("s"), "x", "y", "dist"), "near")
    n, ones = F.col("n"), F.col("ones")
    same = nodes.select(F.col("first").alias("a"), F.col("first").alias("b"), F.lit(0).cast("long").alias("dist"), (_within(n, ones) - F.col("own_top")).alias("dist_top"), ((n * (n - 1) / 2).cast("long") - F.col("own_n")).alias("n"))
    side = lambda t, x, own, *more: t.select("s", F.col("h").alias(x), *[F.col(c).alias(f"{c}_{own}") for c in ("first", "n", "ones")], *more)
    size, bits = F.col("n_a") * F.col("n_b"), _across(F.col("n_a"), F.col("ones_a"), F.col("n_b"), F.col("ones_b"))
    near = pairs.join(side(nodes, "x", "a"), ["s", "x"]).join(side(nodes, "y", "b"), ["s", "y"]).select("s", "x", "y", "dist", "first_a", "first_b", size.alias("n"), bits.alias("dist_top"))
    if exclude_exact:  # copies under two hashes are no edges
        copies = pairs.join(side(classes, "x", "a", "kind"), ["s", "x"]).join(side(classes, "y", "b", "kind"), ["s", "y", "kind"])
        copies = copies.groupBy("s", "x", "y").agg(F.sum(size).alias("less"), F.sum(bits).alias("less_top"))
        near = near.join(copies, ["s", "x", "y"], "left").na.fill(0, ["less", "less_top"]).withColumn("n", n - F.col("less")).withColumn("dist_top", F.col("dist_top") - F.col("less_top"))
    near = near.select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"), (F.col("dist") * n).cast("long").alias("dist"), "dist_top", "n")
    return same.unionByName(near).filter("n > 0")


def _block_rows(unit: DataFrame) -> int:
    """Rows of a block: rows move once for every block they meet, so blocks grow with the table, as far as two fit well into a task."""
    n, width = unit.agg(F.count("*"), F.max(F.size("u"))).first()
    return max(BLOCK_ROWS, min(n // BLOCKS, BLOCK_NUMBERS // max(width or 1, 1)))


def cosine_blocks(vectors: DataFrame, threshold: float, column: str = "v", block_rows: int | None = None, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame, float]:
    """Unit vectors in blocks (``ord, u, block``), the pairs of blocks that can hold a cosine of ``threshold``, and the share of pairs that can't.

    Angles are a metric: vectors within an angle of each other are within it in their
    angles to every pivot, too. Blocks are rings around the nearest of the pivots, which
    are vectors of the table. Without ``block_rows`` they grow with the table, within a
    bound.
    """
    def units(batches):
        for batch in batches:
            batch = batch.filter(batch.column("v").is_valid())
            v = batch.column("v")
            if len(v):
                x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
                size = np.sqrt((x * x).sum(axis=1))
                kept = size > 0
                yield pa.RecordBatch.from_arrays([batch.column("ord").filter(pa.array(kept)), pa.array(list(x[kept] / size[kept, None]), pa.list_(pa.float64()))], ["ord", "u"])

    # Nulls are left out by the kernel: a filter would be evaluated below the columns that the vectors are made of, again for each number.
    own = vectors.select("ord", F.col(column).cast("array<double>").alias("v"))
    unit = materialise(own.mapInArrow(units, "ord long, u array<double>"), "units")
    chosen = np.array(tiles.sample(unit, "u", pivots), float)
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)

    def angles(batches):
        for batch in batches:
            u = batch.column("u")
            x = u.flatten().to_numpy().reshape(len(u), -1)
            d = np.arccos(np.clip(x @ shared.value.T, -1, 1)) if len(u) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("ord"), u, pa.array(list(d), pa.list_(pa.float64()))], ["ord", "u", "d"])

    rows = unit.mapInArrow(angles, "ord long, u array<double>, d array<double>")
    rows = tiles.in_rings(rows, F.col("d"), F.asc("ord"), block_rows=block_rows or _block_rows(unit))
    pairs, skipped = tiles.block_pairs(rows, F.col("d"), float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6)
    return rows.drop("d"), pairs, skipped


def _bound(x: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Some numbers of each vector and the length of all others: the product of two such rows is no less than that of the vectors."""
    return np.column_stack([x[:, order[:width]], np.sqrt((x[:, order[width:]] ** 2).sum(axis=1))]).astype(np.float32)


def _slack(width: int) -> float:
    """What single precision takes from a product of unit vectors, at most."""
    return 1e-9 + 2.4e-7 * (width + 8)


def _width(x: np.ndarray, y: np.ndarray, order: np.ndarray, threshold: float) -> int:
    """For how many numbers a bound costs least: fewer are multiplied faster, but leave more pairs to be checked."""
    few = [t[:: max(1, len(t) // 256)][:256] for t in (x, y)]

    def cost(width: int) -> float:
        a, b = (_bound(t, order, width) for t in few)
        return BOUND_COST + width * NUMBER_COST + len(order) * CHECK_COST * float((a @ b.T >= threshold - _slack(width)).mean())

    return min({-(-len(order) * k // 8) for k in range(1, 9)}, key=cost)


def _near_vectors(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places i, j of unit vectors with a cosine of ``threshold`` or more, and that cosine, part by part; i < j if both are the ``same``.

    Products of some numbers, and of the lengths of the rest, bound the cosine from above
    (Cauchy and Schwarz); only pairs that pass are checked, in double precision.
    """
    if not len(x) or not len(y):
        return
    order = np.argsort(-((x * x).mean(axis=0) + (y * y).mean(axis=0)), kind="stable")
    width = _width(x, y, order, threshold)
    a, b = (_bound(t, order, width) for t in (x, y))
    room = -(-LEFT_ROWS * RIGHT_ROWS // 8) * 8
    product, near = np.empty(room, np.float32), np.zeros(room, bool)
    for lo in range(0, len(x), LEFT_ROWS):
        own = a[lo : lo + LEFT_ROWS]
        for at in range(lo if same else 0, len(y), RIGHT_ROWS):
            rest = b[at : at + RIGHT_ROWS]
            n = len(own) * len(rest)
            np.matmul(own, rest.T, out=product[:n].reshape(len(own), -1))
            np.greater_equal(product[:n], threshold - _slack(width), out=near[:n])
            near[n : n + 8] = False
            found = _places(near, n)
            for k in range(0, len(found), CHECKED_ROWS):
                i, j = np.divmod(found[k : k + CHECKED_ROWS], len(rest))
                i, j = i + lo, j + at
                if same:
                    i, j = i[i < j], j[i < j]
                exact = (x[i] * y[j]).sum(axis=1)
                yield i[exact >= threshold], j[exact >= threshold], exact[exact >= threshold]


def cosine_edges(vectors: DataFrame, threshold: float = 0.85, column: str = "v", block_rows: int | None = None) -> DataFrame:
    """``(a, b, cosine)``, a < b by ``ord``: all pairs of vectors with a cosine of ``threshold`` or more, exactly.

    Blocks against blocks, by matrix products that bound the cosine, without the pairs of
    blocks that the triangle inequality rules out. Zero vectors have no edges.
    """
    rows, pairs, _ = cosine_blocks(vectors, threshold, column, block_rows)
    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pairs.count(), MOST_TASKS))

    def kernel(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        (p, x), (q, y) = ((t.column("ord").to_numpy(), t.column("u").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)) for t in (a, b))
        for i, j, cosine in _near_vectors(x, y, threshold, same):
            keep = p[i] != q[j]
            found.append((np.minimum(p[i], q[j])[keep], np.maximum(p[i], q[j])[keep], cosine[keep]))
        return pa.table(dict(zip(("a", "b", "cosine"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    return tiles.compare(rows, pairs, kernel, "a long, b long, cosine double", tasks).dropDuplicates(["a", "b"])


def cosine_candidates(vectors: DataFrame, threshold: float = 0.85, column: str = "v", width: float = 0.5, tables: int = 8, seed: int = 11) -> DataFrame:
    """``cosine_edges`` through locality-sensitive hashing: may miss edges, doesn't compare blocks."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    unit = vectors.select("ord", array_to_vector(l2_normalise(F.col(column))).alias("u"))
    model = BucketedRandomProjectionLSH(inputCol="u", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    near = model.approxSimilarityJoin(unit, unit, (2 - 2 * threshold) ** 0.5 + 1e-9, "d").filter("datasetA.ord < datasetB.ord")
    return near.select(F.col("datasetA.ord").alias("a"), F.col("datasetB.ord").alias("b"), (1 - F.col("d") * F.col("d") / 2).alias("cosine")).filter(F.col("cosine") >= threshold)


def sample_keyframes(frames: DataFrame, interval: float = 2.0) -> DataFrame:
    """Frames whose number is a multiple of ``floor(fps * interval)``; videos where that is 0 have none."""
    step = F.floor(F.col("fps") * interval)
    return frames.filter((step >= 1) & (F.col("frame_no") % step == 0))


def video_hashes(keyframes: DataFrame) -> DataFrame:
    """``(video, hashes)``: each video's frame hashes in order."""
    ordered = F.sort_array(F.collect_list(F.struct("frame_idx", "h")))
    return keyframes.groupBy("video").agg(F.transform(ordered, lambda s: s["h"]).alias("hashes"))


def video_edges(keyframes: DataFrame, threshold: int = 10, least: float = 0.5) -> DataFrame:
    """``(a, b, share)``, a < b: the share of a's keyframes with a match in b, where over ``least``.

    A frame's best match is near enough exactly if some match is, so frames are joined
    on near pairs of distinct hashes and counted.
    """
    frames = keyframes.select("video", "frame_idx", "h")
    hashes = frames.select(F.lit(None).cast("string").alias("scope"), "h")
    near = hamming_pairs(hashes, threshold).select("x", "y")
    one = frames.select("h").distinct()
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(one.select(F.col("h").alias("x"), F.col("h").alias("y")))
    a = frames.select(F.col("video").alias("a"), F.col("frame_idx").alias("fa"), F.col("h").alias("x"))
    b = frames.select(F.col("video").alias("b"), F.col("h").alias("y")).distinct()
    met = a.join(both, "x").join(b, "y").filter("a < b").groupBy("a", "b").agg(F.count_distinct("fa").alias("met"))
    sizes = frames.groupBy(F.col("video").alias("a")).agg(F.count_distinct("frame_idx").alias("n"))
    return met.join(sizes, "a").withColumn("share", F.col("met") / F.col("n")).filter(F.col("share") > least).select("a", "b", "share")


def candidate_pairs(descriptors: DataFrame, band_bits: int = 16, tile_rows: int = 8192) -> DataFrame:
    """``(a, b)``, a < b, for files with two keypoints that agree in some band of ``band_bits`` bits.

    Sixteen bands of 16 bits find every pair of keypoints within 15 of 256 bits; others
    may be missed. It is an inverted file of bands: the posting list of a value that very
    many files share is dealt into square tiles, so its pairs are made by many tasks.
    """
    low = (1 << band_bits) - 1 if band_bits < 64 else -1
    bands = [F.shiftrightunsigned(F.col(f"w{i}"), bit).bitwiseAND(low) for i in range(4) for bit in range(0, 64, band_bits)]
    rows = descriptors.select("file", F.posexplode(F.array(*bands)).alias("band", "value")).distinct()
    met = join_tiled(rows.withColumnRenamed("file", "a"), rows.withColumnRenamed("file", "b"), ["band", "value"], tile_rows)
    return met.filter("a < b").select("a", "b").distinct()


def _score(good: Column, kp_a: Column, kp_b: Column) -> Column:
    """The good share of the smaller file's keypoints; 0 with under two."""
    least = F.least(kp_a, kp_b)
    return F.when(least < 2, 0.0).otherwise(F.round(F.least(F.lit(1.0), good / least), 3))


def _packed(table: pa.Table, masks: list[int]) -> np.ndarray:
    """The bits of every descriptor that the masks name, next to each other in as few 64-bit words as hold them."""
    words = np.stack([table.column(f"w{i}").to_numpy() for i in range(4)], axis=1)
    kept = np.unpackbits(np.array(masks, np.int64).view(np.uint8)).astype(bool)
    bits = np.packbits(np.unpackbits(words.view(np.uint8), axis=1)[:, kept], axis=1)
    out = np.zeros((len(words), max(1, -(-bits.shape[1] // 8)) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view(np.uint64)


def good_matches(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, ratio: float) -> np.ndarray:
    """How many keypoints of every file of a (row) have a good match in every file of b (column).

    ``a`` and ``b`` are rows of 64-bit words, keypoints of a file next to each other, from
    ``a_first`` and ``b_first`` on. A good match is nearer than ``ratio`` times the second
    nearest. All files' first keypoints are compared at once, then all second ones, and
    so on; files with many come first, so those that still have one are in a row.
    """
    sizes = np.diff(np.append(b_first, len(b)))
    order = np.argsort(-sizes, kind="stable")
    still = [int((sizes > k).sum()) for k in range(int(sizes.max()))]
    slots = [np.ascontiguousarray(b[b_first[order[:n]] + k].T) for k, n in enumerate(still)]
    far = 64 * a.shape[1] + 1
    kind = np.uint8 if far < 256 else np.uint16
    limit = np.ceil(ratio * np.arange(far + 1)).astype(kind)  # what the nearest stays under, for each second nearest
    out = np.zeros((len(a), len(b_first)), bool)
    step = max(1, (1 << 17) // len(b_first))
    for lo in range(0, len(a), step):
        own = a[lo : lo + step]
        nearest, second = (np.full((len(own), len(b_first)), far, kind) for _ in range(2))
        for n, slot in zip(still, slots, strict=True):
            d = np.bitwise_count(own[:, 0, None] ^ slot[0]).astype(kind, copy=False)
            for w in range(1, a.shape[1]):
                d += np.bitwise_count(own[:, w, None] ^ slot[w])
            one, two = nearest[:, :n], second[:, :n]
            np.minimum(two, np.maximum(one, d), out=two)
            np.minimum(one, d, out=one)
        out[lo : lo + step, order] = nearest < limit[second]
    out[:, sizes < 2] = False
    return np.add.reduceat(out, a_first, axis=0, dtype=np.int32)


def _matched(descriptors: DataFrame, ratio: float, block_rows: int | None, found: Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``found(files, keypoints, files, keypoints, good)`` for all pairs of blocks of files; a pair of files counts where it is the first's turn.

    ``schema`` may name the type of the files as ``{kind}``. Bits that all descriptors
    share are left out, as they part no two. Blocks grow with the table up to a bound.
    """
    words = [f"w{i}" for i in range(4)]
    whole = descriptors.select("file", "kp", *words).dropna()
    ranked = tiles.in_blocks(whole, F.asc("file"), F.asc("kp"), block_rows=1)  # places; blocks follow
    n, *ends = ranked.agg(F.count("*"), *[f(w) for w in words for f in (F.bit_and, F.bit_or)]).first()
    masks = [(x or 0) ^ (y or 0) for x, y in zip(ends[::2], ends[1::2], strict=True)]
    block_rows = block_rows or max(BLOCK_ROWS, min(n // FILE_BLOCKS, MAX_BLOCK_ROWS))
    own = ranked.groupBy("file").agg(F.floor(F.min("block") / block_rows).cast("long").alias("block"))
    rows = materialise(ranked.drop("block").join(own, "file").select("block", "file", *words), "descriptors")
    last = own.agg(F.max("block")).first()[0]
    blocks = descriptors.sparkSession.range(0 if last is None else last + 1)
    pairs = blocks.select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id"), F.lit(last or 0).cast("long"))).alias("j"))
    for side in "ij":  # a file's keypoints may leave a block without any
        pairs = pairs.join(own.select(F.col("block").alias(side)).distinct(), side, "left_semi")
    count = 0 if last is None else (last + 1) * (last + 2) // 2

    def kernel(a: pa.Table, b: pa.Table, same: bool) -> pa.Table:
        sides = []
        for t in (a,) if same else (a, b):
            t = t.sort_by("file").combine_chunks()
            names = t.column("file").combine_chunks()
            new = np.append(True, np.asarray(pc.not_equal(names[1:], names[:-1]), bool))
            first = np.flatnonzero(new)
            sides.append((names.take(pa.array(first)), first, np.diff(np.append(first, len(names))), _packed(t, masks)))
        (x, xf, xn, xs), (y, yf, yn, ys) = sides[0], sides[-1]
        good = good_matches(xs, xf, ys, yf, ratio)
        return found(x, xn, y, yn, np.triu(good, 1) if same else good)

    tasks = max(int(descriptors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(count, n * n // (2 * TASK_PAIRS)))
    return tiles.compare(rows, pairs, kernel, schema.format(kind=rows.schema["file"].dataType.simpleString()), tasks)


def descriptor_scores(descriptors: DataFrame, ratio: float = 0.75, block_rows: int | None = None) -> DataFrame:
    """``(a, b, kp_a, kp_b, good, score)`` of all pairs of files a < b that have a good match, exactly.

    ``descriptors``: ``file, kp, w0, w1, w2, w3``, four 64-bit words. Every keypoint of a
    takes its two nearest of b by the Hamming distance; it is a good match if the nearer
    is closer than ``ratio`` times the other. The score is the good share of the file
    with fewer keypoints, 0 if that has under two; pairs without a good match score 0,
    too, and have no row. All pairs count, since a keypoint's nearest may be good
    however far it is; so files are dealt into blocks of about ``block_rows`` keypoints
    in their order, and blocks are compared with blocks. Keypoints of a file
    stay together; an extractor bounds their number.
    """

    def found(x, xn, y, yn, good) -> pa.Table:
        i, j = np.nonzero(good)
        return pa.table([x.take(pa.array(i)), y.take(pa.array(j)), pa.array(xn[i]), pa.array(yn[j]), pa.array(good[i, j].astype(np.int64))], ["a", "b", "kp_a", "kp_b", "good"])

    rows = _matched(descriptors, ratio, block_rows, found, "a {kind}, b {kind}, kp_a long, kp_b long, good long")
    return rows.withColumn("score", _score(F.col("good"), F.col("kp_a"), F.col("kp_b")))


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 to n - 1 reaches by the edges i, j."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        now = root.copy()
        for end in (root[i], root[j], i, j):
            np.minimum.at(now, end, least)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def feature_links(descriptors: DataFrame, least: float = 0.15, ratio: float = 0.75, block_rows: int | None = None) -> DataFrame:
    """``(a, b, score, n)``: ``feature_edges`` of all pairs, added up where their blocks are compared.

    ``n`` edges whose sum of scores is ``score`` belong to file b, which reaches a by
    edges of the same two blocks. So components and means are those of the edges, but
    two blocks give a row for each of their files at most, not for each of their pairs.
    """

    def found(x, xn, y, yn, good) -> pa.Table:
        few = np.minimum(xn[:, None], yn[None, :])
        score = np.where(few < 2, 0, np.minimum(1000, (2000 * good.astype(np.int64) + few) // (2 * few))) / 1000  # rounded half up, as ``_score``
        i, j = np.nonzero((good > 0) & (score >= least))
        names = pa.concat_arrays([x, y]) if x is not y else x
        to = j + len(x) if x is not y else j
        root = _roots(len(names), i, to)
        n, total = np.bincount(i, minlength=len(names)), np.bincount(i, score[i, j], minlength=len(names))
        met = np.flatnonzero((n > 0) | (np.bincount(to, minlength=len(names)) > 0))
        return pa.table([names.take(pa.array(root[met])), names.take(pa.array(met)), pa.array(total[met].astype(float)), pa.array(n[met])], ["a", "b", "score", "n"])

    return _matched(descriptors, ratio, block_rows, found, "a {kind}, b {kind}, score double, n long")


def descriptor_matches(descriptors: DataFrame, pairs: DataFrame, ratio: float = 0.75) -> DataFrame:
    """``(a, b, kp_a, kp_b, good, score)`` for each candidate pair.

    Every keypoint of a takes its two nearest of b by the Hamming distance of four
    64-bit words; it is a good match if the nearer is closer than ``ratio`` times the
    other. The score is the good share of the smaller file, 0 with under two keypoints.
    """
    counts = descriptors.groupBy("file").agg(F.count("*").alias("n"))
    words = [f"w{i}" for i in range(4)]
    x = descriptors.select(F.col("file").alias("a"), F.col("kp").alias("ka"), *[F.col(w).alias(f"x{w}") for w in words])
    y = descriptors.select(F.col("file").alias("b"), F.col("kp").alias("kb"), *[F.col(w).alias(f"y{w}") for w in words])
    distance = sum((hamming(F.col(f"x{w}"), F.col(f"y{w}")) for w in words[1:]), hamming(F.col("xw0"), F.col("yw0")))
    near = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("d", distance)
    two = near.withColumn("r", F.row_number().over(W.partitionBy("a", "b", "ka").orderBy("d", "kb"))).filter("r <= 2")
    best = two.groupBy("a", "b", "ka").agg(F.min("d").alias("d1"), F.max("d").alias("d2"), F.count("*").alias("k"))
    good = best.groupBy("a", "b").agg(F.sum(((F.col("k") == 2) & (F.col("d1") < ratio * F.col("d2"))).cast("long")).alias("good"))
    sized = pairs.select("a", "b").join(counts.select(F.col("file").alias("a"), F.col("n").alias("kp_a")), "a", "left").join(counts.select(F.col("file").alias("b"), F.col("n").alias("kp_b")), "b", "left").na.fill(0, ["kp_a", "kp_b"])
    out = sized.join(good, ["a", "b"], "left").na.fill(0, ["good"])
    return out.select("a", "b", "kp_a", "kp_b", "good", _score(F.col("good"), F.col("kp_a"), F.col("kp_b")).alias("score"))


def feature_edges(descriptors: DataFrame, least: float = 0.15, ratio: float = 0.75, pairs: DataFrame | None = None) -> DataFrame:
    """Pairs of files that score ``least`` or more: of all pairs, or of the given candidates ``(a, b)``."""
    found = descriptor_scores(descriptors, ratio) if pairs is None else descriptor_matches(descriptors, pairs, ratio)
    return found.filter(F.col("score") >= least)
