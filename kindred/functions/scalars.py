"""Column functions: paths, hashes, display text, media arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Suffixes of each kind of file.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff", ".webp", ".heic", ".heif", ".avif")
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".flv", ".webm")
DOCUMENT_SUFFIXES = (".xlsx", ".xls", ".pdf")
ARCHIVE_SUFFIXES = (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".tgz", ".tar.gz", ".tar.bz2")

#: How the methods are shown, in the order of reports.
METHOD_LABELS = {"exact": "Exact match", "perceptual": "Perceptual match", "feature": "Feature match", "video": "Video match", "semantic": "Semantic match"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; ``.tar.gz`` and ``.tar.bz2`` whole; empty without one."""
    name = F.lower(file_name(path))
    return F.regexp_extract(name, r"(?<=.)(\.tar\.(?:gz|bz2)|\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return name.substr(F.lit(1), F.length(name) - F.length(suffix(path)))


def format_name(path: Column) -> Column:
    """The suffix without its dot."""
    return F.regexp_replace(suffix(path), r"^\.", "")


def kind(path: Column) -> Column:
    """``image``, ``video``, ``document``, ``archive`` or ``other``."""
    s = suffix(path)
    return F.when(s.isin(*IMAGE_SUFFIXES), "image").when(s.isin(*VIDEO_SUFFIXES), "video").when(s.isin(*DOCUMENT_SUFFIXES), "document").when(s.isin(*ARCHIVE_SUFFIXES), "archive").otherwise("other")


def hex_to_long(text: Column) -> Column:
    """A hash of up to 16 hexadecimal digits as a signed 64-bit integer; null stays null."""
    return F.conv(text, 16, -10).cast("long")


def long_to_hex(value: Column, digits: int = 16) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def human_size(n: Column) -> Column:
    """Bytes with one decimal in the largest of B, KB, MB, GB, TB that keeps the number below 1024."""
    x = n.cast("double")
    out = F.format_string("%.1f TB", x / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(x < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", x / 1024.0**power)).otherwise(out)
    return out


def shorten_path(path: Column, most: int = 50) -> Column:
    """The end of a long path behind dots, ``most`` characters in all."""
    return F.when(F.length(path) > most, F.concat(F.lit("..."), path.substr(F.length(path) - (most - 4), F.lit(most - 3)))).otherwise(path)


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def dimensions_text(width: Column, height: Column) -> Column:
    return F.concat(F.coalesce(width, F.lit(0)).cast("string"), F.lit("x"), F.coalesce(height, F.lit(0)).cast("string"))


def method_label(method: Column, multi_account: Column | None = None) -> Column:
    label = method
    for name, text in METHOD_LABELS.items():
        label = F.when(method == name, text).otherwise(label)
    return label if multi_account is None else F.when(F.coalesce(multi_account, F.lit(False)), F.concat(label, F.lit(" (multi-account)"))).otherwise(label)


def date_of_epoch(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def source_key(paths: Column) -> Column:
    """The text that identifies a list of sources; its order counts."""
    return F.to_json(paths)


def truncate_text(text: Column, most: int = 200) -> Column:
    return F.substring(text, 1, most)


def duration_seconds(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(0.0)


def keyframe_count(frames: Column, fps: Column, interval: float = 2.0) -> Column:
    return F.when(fps > 0, F.floor(frames / (fps * interval))).otherwise(0).cast("long")


def content_digests(content: Column) -> list[Column]:
    """MD5 and SHA-256, as columns named so."""
    return [F.md5(content).alias("md5"), F.sha2(content, 256).alias("sha256")]


def l2_normalise(vector: Column) -> Column:
    """The vector in doubles over its length; a zero vector stays as it is."""

    def once(value: Column, f) -> Column:
        """``f`` of a value that isn't computed again for each number in it."""
        return F.transform(F.array(value), f)[0]

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return once(norm, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))

    return once(F.transform(vector, lambda x: x.cast("double")), scaled)


def renamed(prefix: Column, index: Column, path: Column, digits: int = 3) -> Column:
    """``prefix_007.ext``: a running index of at least so many digits, the suffix kept."""
    return F.concat(prefix, F.lit("_"), F.format_string(f"%0{digits}d", index.cast("long")), suffix(path))
