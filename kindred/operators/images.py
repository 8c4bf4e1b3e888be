"""Fingerprints of pictures: resampling, perceptual hashes, and the job that computes what a cache lacks.

Pictures are rows of height, width, channels and bytes, as Spark's image source gives
them (blue first when there is colour).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.functions import scalars as S
from kindred.sources.files import size_guards
from kindred.sources.store import cache_lookup, cache_upsert, split_errors

MAX_PIXELS = 178_000_000
#: Shares of red, green and blue in grey.
GREY = (0.299, 0.587, 0.114)


def to_grey(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Grey levels in doubles, a whole number each; an alpha channel is left out."""
    px = np.frombuffer(data, np.uint8, height * width * channels).reshape(height, width, channels).astype(np.float64)
    if channels < 3:
        return px[:, :, 0]
    return np.floor(px[:, :, 2] * GREY[0] + px[:, :, 1] * GREY[1] + px[:, :, 0] * GREY[2] + 0.5)


@cache
def _resampling(old: int, new: int, support: float) -> np.ndarray:
    """Weights of old samples for each new one: Lanczos for ``support`` 3, area means for 0."""
    scale = max(old / new, 1.0)
    centre = (np.arange(new) + 0.5) * old / new
    at = np.arange(old) + 0.5
    if support:
        x = (at[None] - centre[:, None]) / scale
        w = np.where(np.abs(x) < support, np.sinc(x) * np.sinc(x / support), 0.0)
    else:
        lo, hi = centre - scale / 2, centre + scale / 2
        w = np.clip(np.minimum(at[None] + 0.5, hi[:, None]) - np.maximum(at[None] - 0.5, lo[:, None]), 0, None)
    return w / w.sum(axis=1, keepdims=True)


def resize(grey: np.ndarray, height: int, width: int, support: float = 3.0) -> np.ndarray:
    rows, columns = _resampling(grey.shape[0], height, support), _resampling(grey.shape[1], width, support)
    return np.clip(np.floor(rows @ grey @ columns.T + 0.5), 0, 255)


def cap(grey: np.ndarray, most_pixels: int = MAX_PIXELS, longest: int | None = None) -> np.ndarray:
    """Shrunk to the pixel limit by area, or to the longest side."""
    h, w = grey.shape
    factor = min(1.0, (most_pixels / (h * w)) ** 0.5, (longest / max(h, w)) if longest else 1.0)
    return grey if factor >= 1 else resize(grey, max(1, int(h * factor)), max(1, int(w * factor)), 0.0)


@cache
def _dct(n: int, keep: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(keep)[:, None] * (2 * np.arange(n)[None] + 1) / (2 * n))


def _bits(b: np.ndarray) -> int:
    """Bits in reading order, the first one highest, as a signed long."""
    return int(np.packbits(b.ravel()).view(">i8")[0])


def phash(grey: np.ndarray) -> int:
    """The low 8 by 8 block of the DCT of a 32 by 32 picture against its median."""
    low = _dct(32, 8) @ resize(grey, 32, 32) @ _dct(32, 8).T
    return _bits(low > np.median(low))


def dhash(grey: np.ndarray) -> int:
    small = resize(grey, 8, 9)
    return _bits(small[:, 1:] > small[:, :-1])


def ahash(grey: np.ndarray) -> int:
    small = resize(grey, 8, 8)
    return _bits(small > small.mean())


def top_of(grey: np.ndarray, ratio: float = 0.08) -> np.ndarray:
    return grey[: max(1, int(grey.shape[0] * ratio))]


HASHES: dict[str, Callable[[np.ndarray], int]] = {"phash": phash, "dhash": dhash, "ahash": ahash, "phash_top": lambda g: phash(top_of(g))}


def hash_udf(kind: str):
    """A pandas UDF ``(height, width, channels, data) -> long`` for one of ``HASHES``; null for a picture that didn't decode."""
    make = HASHES[kind]

    @F.pandas_udf("long")
    def hashed(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        rows = zip(height, width, channels, data, strict=True)
        return pd.Series([make(cap(to_grey(h, w, c, d))) if d is not None and h > 0 and w > 0 else None for h, w, c, d in rows], dtype="Int64")

    return hashed


def image_hashes(images: DataFrame, top_crop: float = 0.08) -> DataFrame:
    """``path, width, height`` and the four hashes in hexadecimal from ``path, height, width, nChannels, data``.

    One decode and one grey conversion serve all four. Pictures of no size give an
    error row instead of hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = lambda x: f"{x & (1 << 64) - 1:016x}"
        for batch in batches:
            rows = []
            for path, h, w, c, cell in zip(*[batch.column(n).to_pylist() for n in ("path", "height", "width", "nChannels")], batch.column("data"), strict=True):
                data = cell.as_py()
                if not data or h <= 0 or w <= 0:
                    rows.append((path, None, None, None, None, None, None, "hash", "UndecodableImage", "no picture"))
                    continue
                grey = cap(to_grey(h, w, c, data))
                rows.append((path, w, h, *(hexed(f(grey)) for f in (phash, dhash, ahash)), hexed(phash(top_of(grey, top_crop))), "hash", None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    names = ["path", "width", "height", "phash", "dhash", "ahash", "phash_top", "stage", "error_type", "error_message"]
    kinds = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 7
    schema = "path string, width long, height long, phash string, dhash string, ahash string, phash_top string, stage string, error_type string, error_message string"
    return images.select("path", "height", "width", "nChannels", "data").mapInArrow(run, schema)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures under a path; what can't be decoded has width -1 and no data."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", False).load(path)
    return found.select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), "image.height", "image.width", "image.nChannels", F.when(F.col("image.width") > 0, F.col("image.data")).alias("data"))


def fingerprint(files: DataFrame, images: DataFrame, cache: DataFrame, require_decodable: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(fingerprints, errors, new cache)`` of a manifest with ``content``.

    Hits come from the cache; misses are decoded, digested and hashed in the scan's own
    tasks, and only digests and hashes go on. A picture that can't be decoded drops out
    of everything, exact matching too, unless ``require_decodable`` is false. Empty and
    too large files are errors before anything is read.
    """
    files, refused = split_errors(size_guards(files))
    hits, misses = cache_lookup(files.drop("content"), cache)
    digests = files.select("path", *S.content_digests(F.col("content")))
    hashed = misses.join(image_hashes(images), "path").join(digests, "path").withColumn("computed_at", F.unix_timestamp().cast("double"))
    good = hashed.filter("error_type is null") if require_decodable else hashed
    errors = hashed.filter("error_type is not null").select("path", "stage", "error_type", F.col("error_message").alias("message"))
    columns = ["path", "length", "mtime", "md5", "sha256", "phash", "dhash", "ahash", "phash_top", "width", "height", "computed_at"]
    fresh = good.select(columns)
    return hits.select(columns).unionByName(fresh), errors.unionByName(refused), cache_upsert(cache.select(columns), fresh)


def embed(fn: Callable[[list[bytes]], np.ndarray], batch: int = 32):
    """An iterator pandas UDF ``content -> array<double>`` around a model of the user's; failures give null."""

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list = []
            for lo in range(0, len(s), batch):
                part = list(s.iloc[lo : lo + batch])
                try:
                    out += [np.asarray(v, float) for v in fn(part)]
                except Exception:  # one bad input must not cost its whole batch
                    for x in part:
                        try:
                            out.append(np.asarray(fn([x])[0], float))
                        except Exception:
                            out.append(None)
            yield pd.Series(out)

    return run


def describe(files: DataFrame, fn: Callable[[bytes], np.ndarray]) -> DataFrame:
    """``(file, kp, w0..w3)``: 256-bit descriptors, one row each, from a detector of the user's (n by 32 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, cell in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                d = np.ascontiguousarray(fn(cell.as_py()), np.uint8).reshape(-1, 32).view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(d), pa.string()), pa.array(np.arange(len(d), dtype=np.int64)), *[pa.array(np.ascontiguousarray(d[:, i])) for i in range(4)]], ["file", "kp", "w0", "w1", "w2", "w3"])

    return files.select("path", "content").mapInArrow(run, "file string, kp long, w0 long, w1 long, w2 long, w3 long")


def grey_tile(pixels: Column, side: int) -> list[Column]:
    """A row of grey levels as picture columns."""
    data = F.unhex(F.array_join(F.transform(pixels, lambda p: F.lpad(F.hex(p.cast("long")), 2, "0")), ""))
    return [F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(1).alias("nChannels"), data.alias("data")]
