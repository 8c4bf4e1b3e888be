"""Forensic figures of pictures and pairs of pictures: scores and small arrays, no drawings."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kindred.operators.images import cap, resize, to_grey
from kindred.plans.options import ScanOptions
from kindred.plans.order import group_rank
from kindred.plans.storage import materialise

#: The luminance quantisation table of baseline JPEG at quality 50, row by row.
JPEG_LUMINANCE = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)


def metadata_diff(a: Column, b: Column) -> Column:
    """The sorted keys whose values differ between two maps; a key that one lacks differs."""
    none = F.create_map().cast("map<string,string>")
    x, y = F.coalesce(a, none), F.coalesce(b, none)
    return F.array_sort(F.filter(F.array_union(F.map_keys(x), F.map_keys(y)), lambda k: ~x[k].eqNullSafe(y[k])))


def histogram(pixels: DataFrame, key: str, level: str, bins: int = 256) -> DataFrame:
    """``(key, bin, share)`` from one row for each pixel; bins without pixels are left out."""
    n = pixels.groupBy(key).agg(F.count("*").alias("n"))
    counts = pixels.groupBy(key, F.col(level).cast("int").alias("bin")).agg(F.count("*").alias("c")).filter(F.col("bin").between(0, bins - 1))
    return counts.join(n, key).select(key, "bin", (F.col("c") / F.col("n")).alias("share"))


def histogram_array(pixels: Column, bins: int = 256) -> Column:
    """The shares of all levels of an array of pixels."""
    n = F.size(pixels)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(pixels, lambda p: p == b)) / n)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two arrays, rounded to four digits; 0 if one is constant."""
    names = ("n", "a", "b", "aa", "bb", "ab")
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def step(s: Column, p: Column) -> Column:
        x, y = p["x"], p["y"]
        more = (F.lit(1.0), x, y, x * x, y * y, x * y)
        return F.struct(*[(s[k] + m).alias(k) for k, m in zip(names, more, strict=True)])

    def finish(s: Column) -> Column:
        size = (s["aa"] - s["a"] * s["a"] / s["n"]) * (s["bb"] - s["b"] * s["b"] / s["n"])
        return F.when(size > 1e-18, F.round((s["ab"] - s["a"] * s["b"] / s["n"]) / F.sqrt(size), 4)).otherwise(0.0)

    return F.aggregate(pairs, F.struct(*[F.lit(0.0).alias(k) for k in names]), step, finish)


def pixel_difference(a: np.ndarray, b: np.ndarray, threshold: float = 30) -> tuple[float, float, float]:
    """Mean and largest difference, and the percentage over the threshold; b is resized to a."""
    d = np.abs(a - (b if b.shape == a.shape else resize(b, *a.shape)))
    return round(float(d.mean()), 6), float(d.max()), round(100 * float((d > threshold).mean()), 6)


def noise_level(grey: np.ndarray, sigma: float = 3.0) -> float:
    """Deviation of what a Gaussian blur takes away; the edge is mirrored."""
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = grey
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
        out = sum(w * np.take(padded, range(i, i + grey.shape[axis]), axis=axis) for i, w in enumerate(k))
    return round(float((grey - out).std()), 2)


def error_levels(grey: np.ndarray, quality: int = 90, gain: float = 20.0) -> np.ndarray:
    """The amplified loss of one JPEG quantisation of 8 by 8 blocks, pixel by pixel."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    table = np.clip(np.floor((np.array(JPEG_LUMINANCE) * scale + 50) / 100), 1, 255)
    h, w = grey.shape
    padded = np.pad(grey, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
    c = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).swapaxes(1, 2)
    back = c.T @ (np.round(c @ blocks @ c.T / table) * table) @ c
    again = np.clip(np.round(back.swapaxes(1, 2).reshape(padded.shape) + 128), 0, 255)[:h, :w]
    return np.clip(np.abs(again - grey) * gain, 0, 255)


def error_level(grey: np.ndarray, quality: int = 90, gain: float = 20.0) -> tuple[float, float, float]:
    """Mean, largest and bright share of the error levels."""
    e = error_levels(grey, quality, gain)
    return round(float(e.mean()), 2), float(e.max()), round(float((e > 128).mean()), 4)


def edges(grey: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge pixels: Sobel gradients thinned along their direction, weak ones kept where they touch strong ones."""
    p = np.pad(grey, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    around = np.pad(size, 1)
    shift = lambda dy, dx: around[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    ax, ay = np.abs(gx), np.abs(gy)
    flat, steep = ay <= 0.4142 * ax, ay >= 2.4142 * ax
    same = gx * gy > 0
    before = np.select([flat, steep, same], [shift(0, -1), shift(-1, 0), shift(-1, -1)], shift(-1, 1))
    after = np.select([flat, steep, same], [shift(0, 1), shift(1, 0), shift(1, 1)], shift(1, -1))
    thin = (size > before) & (size >= after)
    strong, weak = thin & (size > high), thin & (size > low)
    while True:
        g = np.pad(strong, 1)
        grown = weak & np.any([g[1 + y : 1 + y + size.shape[0], 1 + x : 1 + x + size.shape[1]] for y in (-1, 0, 1) for x in (-1, 0, 1)], axis=0)
        if (grown == strong).all():
            return strong
        strong = grown


def edge_share(grey: np.ndarray, low: float = 50, high: float = 150) -> float:
    return round(float(edges(grey, low, high).mean()), 4)


def edge_agreement(a: np.ndarray, b: np.ndarray, low: float = 50, high: float = 150) -> float:
    """Shared edge pixels over all edge pixels of two pictures; 1 if neither has any."""
    x, y = edges(a, low, high), edges(b if b.shape == a.shape else resize(b, *a.shape), low, high)
    either = (x | y).sum()
    return round(float((x & y).sum() / either), 4) if either else 1.0


def _shares(grey: np.ndarray) -> np.ndarray:
    return np.bincount(grey.astype(np.int64).ravel(), minlength=256)[:256] / grey.size


def single_figures(images: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``(path, noise, ela_mean, ela_max, ela_bright, edge_share, histogram)`` of every picture, null where it didn't decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, h, w, c, cell in zip(*[batch.column(n).to_pylist() for n in ("path", "height", "width", "nChannels")], batch.column("data"), strict=True):
                data = cell.as_py()
                if not data or h <= 0 or w <= 0:
                    rows.append((path, *[None] * 6))
                    continue
                g = cap(to_grey(h, w, c, data), longest=2048)
                rows.append((path, noise_level(g, options.noise_sigma), *error_level(g, options.ela_quality, options.ela_gain), edge_share(g, options.edge_low, options.edge_high), _shares(g)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["path", "noise", "ela_mean", "ela_max", "ela_bright", "edge_share", "histogram"]
    kinds = [images.schema["path"].dataType.typeName() == "long" and pa.int64() or pa.string()] + [pa.float64()] * 5 + [pa.list_(pa.float64())]
    key = images.schema["path"].dataType.simpleString()
    return images.select("path", "height", "width", "nChannels", "data").mapInArrow(run, f"path {key}, noise double, ela_mean double, ela_max double, ela_bright double, edge_share double, histogram array<double>")


def pair_figures(pairs: DataFrame, images: DataFrame, options: ScanOptions = ScanOptions(), threshold: float = 30) -> DataFrame:
    """One row ``(a, b, diff_mean, diff_max, diff_percent, edge_agreement, histogram_correlation, noise_a, noise_b)`` for each pair of paths.

    Every picture joins its pairs once; both are decoded in one pass over the pairs.
    """
    one = lambda side: images.select(F.col("path").alias(side), F.struct("height", "width", "nChannels", "data").alias(f"image_{side}"))
    both = pairs.select("a", "b").join(one("a"), "a").join(one("b"), "b")
    key = images.schema["path"].dataType.simpleString()
    arrow = pa.int64() if key == "bigint" else pa.string()
    names = ["a", "b", "diff_mean", "diff_max", "diff_percent", "edge_agreement", "histogram_correlation", "noise_a", "noise_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*[batch.column(n).to_pylist() for n in ("a", "b", "image_a", "image_b")], strict=True):
                if any(not i["data"] or i["width"] <= 0 for i in (x, y)):
                    rows.append((a, b, *[None] * 7))
                    continue
                g, k = (cap(to_grey(i["height"], i["width"], i["nChannels"], i["data"]), longest=2048) for i in (x, y))
                p, q = _shares(g), _shares(k)
                r = round(float(np.corrcoef(p, q)[0, 1]), 4) if p.std() and q.std() else 0.0
                rows.append((a, b, *pixel_difference(g, k, threshold), edge_agreement(g, k, options.edge_low, options.edge_high), r, noise_level(g, options.noise_sigma), noise_level(k, options.noise_sigma)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [arrow, arrow] + [pa.float64()] * 7, strict=True)], names)

    return both.mapInArrow(run, f"a {key}, b {key}, diff_mean double, diff_max double, diff_percent double, edge_agreement double, histogram_correlation double, noise_a double, noise_b double")


#: Pictures on one side of a tile: each is decoded once for the pairs with as many others.
TILE_PICTURES = 32
_OF_ONE = ("noise", "ela_mean", "ela_max", "ela_bright", "edge_share")
_OF_PAIR = ("diff_mean", "diff_max", "diff_percent", "edge_agreement", "histogram_correlation", "ela_diff_mean", "ela_diff_max")


@dataclass(frozen=True)
class Picture:
    """What all pairs of a picture need, worked out once."""

    grey: np.ndarray
    shares: np.ndarray
    levels: np.ndarray
    figures: tuple[float, ...]  # _OF_ONE

    @classmethod
    def of(cls, height: int, width: int, channels: int, data: bytes | None, options: ScanOptions) -> Picture | None:
        if not data or height <= 0 or width <= 0:
            return None
        g = cap(to_grey(height, width, channels, data), longest=2048)
        e = error_levels(g, options.ela_quality, options.ela_gain)
        own = (noise_level(g, options.noise_sigma), *error_level(g, options.ela_quality, options.ela_gain), edge_share(g, options.edge_low, options.edge_high))
        return cls(g, _shares(g), e, own)

    def against(self, other: Picture, options: ScanOptions, threshold: float) -> tuple[float, ...]:
        """_OF_PAIR; the other is resized to this one."""
        r = round(float(np.corrcoef(self.shares, other.shares)[0, 1]), 4) if self.shares.std() and other.shares.std() else 0.0
        levels = other.levels if other.levels.shape == self.levels.shape else resize(other.levels, *self.levels.shape)
        apart = np.abs(self.levels - levels)
        return (*pixel_difference(self.grey, other.grey, threshold), edge_agreement(self.grey, other.grey, options.edge_low, options.edge_high), r, round(float(apart.mean()), 2), round(float(apart.max()), 2))


def group_figures(members: DataFrame, images: DataFrame, metadata: DataFrame | None = None, options: ScanOptions = ScanOptions(), threshold: float = 30, tile: int = TILE_PICTURES) -> DataFrame:
    """One row for every pair of pictures of every group: all figures of both, of the two together, and what their metadata differ in.

    ``members``: ``group_id, path``; ``images`` as from ``read_images``, one row for each
    path; ``metadata``: ``path, metadata``. Returns ``group_id, a, b`` with a < b, the
    figures of ``single_figures`` for either (``noise_a`` and so on), of ``pair_figures``
    and the mean and largest difference of error levels, null where one didn't decode,
    and ``differing``, the metadata keys whose values differ.

    A group's pictures are dealt into slices of ``tile``, and each pair of slices is a
    task's: a picture is decoded once for its pairs with a whole slice, so the bytes that
    move are those of the members times their group's slices, not of its pairs.
    """
    key = images.schema["path"].dataType.simpleString()
    rows = members.select("group_id", F.col("path").cast(key).alias("path")).distinct()
    ranked = group_rank(rows, "__r", ["group_id"], F.asc("path"), first=0)
    sliced = materialise(ranked.withColumn("slice", F.floor(F.col("__r") / tile).cast("int")).drop("__r"), "slices")
    last = sliced.groupBy("group_id").agg(F.max("slice").alias("last"))
    every = sliced.join(last, "group_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = every.select("group_id", "path", "slice", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"))
    tags = images.select("path").withColumn("metadata", F.lit(None).cast("map<string,string>")) if metadata is None else metadata.select("path", F.col("metadata").cast("map<string,string>").alias("metadata"))
    pictures = images.select("path", "height", "width", "nChannels", "data").join(tags, "path", "left")
    whole = dealt.join(pictures, "path", "left")
    arrow = {"bigint": pa.int64(), "int": pa.int32()}.get(key, pa.string())
    group = members.schema["group_id"].dataType.simpleString()
    columns = [f"{c}_{side}" for side in "ab" for c in _OF_ONE] + list(_OF_PAIR)

    def kernel(t: pa.Table) -> pa.Table:
        t = t.sort_by("path")
        names, slices = t.column("path").to_pylist(), t.column("slice").to_pylist()
        found = [Picture.of(h or 0, w or 0, c or 0, d, options) for h, w, c, d in zip(*(t.column(c).to_pylist() for c in ("height", "width", "nChannels", "data")), strict=True)]
        tags = [dict(m or []) for m in t.column("metadata").to_pylist()]
        own = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        out = []
        for x in range(len(names)):
            for y in range(x + 1, len(names)):
                if own or slices[x] != slices[y]:
                    p, q = found[x], found[y]
                    one = [*(p.figures if p else [None] * len(_OF_ONE)), *(q.figures if q else [None] * len(_OF_ONE))]
                    differ = sorted(k for k in {*tags[x], *tags[y]} if (tags[x].get(k) if k in tags[x] else ()) != (tags[y].get(k) if k in tags[y] else ()))
                    out.append((names[x], names[y], *one, *(p.against(q, options, threshold) if p and q else [None] * len(_OF_PAIR)), differ))
        parts = list(zip(*out, strict=True)) if out else [[]] * (3 + len(columns))
        kinds = [arrow, arrow, *[pa.float64()] * len(columns), pa.list_(pa.string())]
        made = [pa.array(list(c), k) for c, k in zip(parts, kinds, strict=True)]
        ids = pa.array([t.column("group_id")[0].as_py()] * len(out), t.schema.field("group_id").type)
        return pa.table([ids, *made], ["group_id", "a", "b", *columns, "differing"])

    schema = f"group_id {group}, a {key}, b {key}, " + ", ".join(f"{c} double" for c in columns) + ", differing array<string>"
    return whole.select("group_id", "path", "slice", "i", "j", "height", "width", "nChannels", "data", "metadata").groupBy("group_id", "i", "j").applyInArrow(kernel, schema)


def ifd0_metadata(files: DataFrame) -> DataFrame:
    """``(path, metadata)``: the first directory of a TIFF or of a JPEG's EXIF block, by tag number, texts cut at 200."""

    def tags(data: bytes) -> dict[str, str]:
        at = data.find(b"Exif\0\0") + 6 if data[:2] == b"\xff\xd8" else 0
        tiff = data[at:] if at != 5 else b""
        order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
        if not order:
            return {}
        num = lambda i, n: int.from_bytes(tiff[i : i + n], order)
        first, out = num(4, 4), {}
        for e in range(first + 2, first + 2 + 12 * min(num(first, 2), 512), 12):
            tag, kind, count = num(e, 2), num(e + 2, 2), num(e + 4, 4)
            if kind == 2:
                start = e + 8 if count <= 4 else num(e + 8, 4)
                out[str(tag)] = tiff[start : start + min(count, 201)].split(b"\0")[0].decode("latin-1")[:200]
            elif kind in (3, 4) and count == 1:
                out[str(tag)] = str(num(e + 8, 2 if kind == 3 else 4))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(tags(c.as_py() or b"").items()) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(found, pa.map_(pa.string(), pa.string()))], ["path", "metadata"])

    return files.select("path", "content").mapInArrow(run, "path string, metadata map<string,string>")
