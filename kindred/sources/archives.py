"""Archives and containers as sources: members as rows, and archives rewritten without some."""

from __future__ import annotations

import bz2
import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kindred.functions import scalars as S
from kindred.plans.options import ScanOptions
from kindred.plans.storage import materialise

SCHEMA = "archive string, member string, member_ord long, length long, content binary, source_type string, source_group string, stage string, error_type string, error_message string"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def _members(name: str, data: bytes, most: int) -> Iterator[tuple[str, int, bytes | None, str | None, str | None]]:
    """``(member, length, bytes, error type, message)``; a member that can't be read doesn't end the archive."""
    low = name.lower()
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for m in z.infolist():
                if m.is_dir():
                    continue
                if m.file_size > most:
                    yield m.filename, m.file_size, None, "MemberTooLarge", f"length {m.file_size}"
                    continue
                try:
                    yield m.filename, m.file_size, z.read(m), None, None
                except Exception as e:  # a damaged member becomes an error row
                    yield m.filename, m.file_size, None, type(e).__name__, str(e)
    elif low.endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2")):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for m in t:
                if not m.isfile():
                    continue
                if m.size > most:
                    yield m.name, m.size, None, "MemberTooLarge", f"length {m.size}"
                    continue
                f = t.extractfile(m)
                yield m.name, m.size, f.read() if f else b"", None, None
    elif low.endswith((".gz", ".bz2")):
        with (gzip.GzipFile(fileobj=io.BytesIO(data)) if low.endswith(".gz") else bz2.BZ2File(io.BytesIO(data))) as f:
            out = f.read(most + 1)
        inner = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        if len(out) > most:
            yield inner, len(out), None, "MemberTooLarge", f"length over {most}"
        else:
            yield inner, len(out), out, None, None
    else:
        raise ValueError("no reader for this kind of archive")


def explode_archives(archives: DataFrame, options: ScanOptions = ScanOptions(), media_only: bool = False) -> DataFrame:
    """A row for each member of ``path, content`` rows: ZIP, TAR (plain, gz, bz2), single gz and bz2 streams, xlsx.

    Members over the limit and unreadable ones come back with ``error_type``; after the
    first member that brings an archive's total over its budget nothing more is taken
    from it. Each member leaves the task before the next is read. With ``media_only`` only images are kept, in xlsx files those under
    ``xl/media``, once for each place that a drawing refers to them.
    """
    most, budget = options.max_member_bytes, options.max_archive_bytes

    def one(*row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, cell in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data, total = cell.as_py() or b"", 0
                group = path if path.lower().endswith(".xlsx") else None
                kind = "document" if group else "archive"
                try:
                    uses = _placements(data) if group and media_only else {}
                    for i, (member, n, content, error, message) in enumerate(_members(path, data, most)):
                        if error is None and (total := total + n) > budget:
                            yield one(path, member, i, n, None, kind, group, "scan", "BudgetExceeded", f"over {budget}")
                            break
                        for _ in range(uses.get(member, 1) if group else 1):
                            yield one(path, member, i, n, content, kind, group, "scan", error, message)
                except Exception as e:  # the archive itself becomes an error row
                    yield one(path, None, 0, 0, None, kind, group, "scan", type(e).__name__, str(e))

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    out = archives.select("path", "content").mapInArrow(run, SCHEMA)
    if not media_only:
        return out
    image = S.kind(F.col("member")) == "image"
    return out.filter(F.col("member").isNull() | (image & (F.col("source_group").isNull() | F.col("member").startswith("xl/media/"))))


def _placements(data: bytes) -> dict[str, int]:
    """How many drawings' relationships point to each medium of an xlsx container (at least once each)."""
    import re

    found: dict[str, int] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if name.startswith("xl/drawings/_rels/"):
                targets = dict(re.findall(r'Id="([^"]+)"[^>]*?Target="\.\./media/([^"]+)"', z.read(name).decode("utf-8", "replace")))
                targets |= {b: a for a, b in re.findall(r'Target="\.\./media/([^"]+)"[^>]*?Id="([^"]+)"', z.read(name).decode("utf-8", "replace"))}
                sheet = name.replace("_rels/", "").removesuffix(".rels")
                drawn = z.read(sheet).decode("utf-8", "replace") if sheet in z.namelist() else ""
                for rid, medium in targets.items():
                    found[f"xl/media/{medium}"] = found.get(f"xl/media/{medium}", 0) + max(1, drawn.count(f'r:embed="{rid}"'))
    return found


def expand_nested(archives: DataFrame, options: ScanOptions = ScanOptions(), max_depth: int = 50) -> DataFrame:
    """Members of archives within archives too, each level read from the one before, until none is left.

    Archives below ``max_depth`` levels (there is no end to some that hold themselves)
    come back unread, with the error ``TooDeep``.
    """
    level, out = archives.select("path", "content"), None
    for depth in range(1, max_depth + 1):
        rows = materialise(explode_archives(level, options), "members")
        inner = (S.kind(F.col("member")) == "archive") & F.col("content").isNotNull()
        if depth == max_depth:
            deep = lambda name, value: F.when(F.coalesce(inner, F.lit(False)), value).otherwise(F.col(name)).alias(name)
            last = {"error_type": F.lit("TooDeep"), "error_message": F.lit(f"below {max_depth} levels"), "content": F.lit(None).cast("binary")}
            rest = rows.select(*[deep(c, last[c]) if c in last else c for c in rows.columns])
            return rest if out is None else out.unionByName(rest)
        leaves = rows.filter(~F.coalesce(inner, F.lit(False)))
        out = leaves if out is None else out.unionByName(leaves)
        level = rows.filter(inner).select(F.concat_ws("/", "archive", "member").alias("path"), "content")
        if level.isEmpty():
            return out
    return out


def manifest_of(members: DataFrame) -> DataFrame:
    """Members as manifest rows: the path is archive/member."""
    path = F.concat_ws("/", "archive", "member")
    return members.filter("error_type is null").select(path.alias("path"), path.alias("original_path"), "length", S.format_name(F.col("member")).alias("format"), "source_type", "source_group", "content")


def within_budget(members: DataFrame, member_limit: int, budget: int) -> DataFrame:
    """Members that an extraction takes: none over ``member_limit``, and of the rest, in order, while the sum stays in ``budget``."""
    sized = members.filter(F.col("size") <= member_limit)
    total = F.sum("size").over(W.partitionBy("archive").orderBy("member_ord").rowsBetween(W.unboundedPreceding, W.currentRow))
    return sized.withColumn("total", total).filter(F.col("total") <= budget)


def prune_archives(members: DataFrame, removals: DataFrame) -> DataFrame:
    """``(archive, n_members, content)``: every archive as a new ZIP without the listed ``archive, member`` rows.

    The bytes come back as rows, to be written to a new place; no archive is changed.
    An archive of which nothing is left becomes an empty ZIP.
    """
    kept = members.filter("error_type is null and content is not null").join(removals.select("archive", "member", F.lit(True).alias("__gone")), ["archive", "member"], "left")

    def build(table: pa.Table) -> pa.Table:
        out, n = io.BytesIO(), 0
        rows = sorted(zip(table.column("member_ord").to_pylist(), table.column("member").to_pylist(), table.column("content"), table.column("__gone").to_pylist(), strict=True), key=lambda r: (r[0], r[1]))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for _, member, content, gone in rows:
                if not gone:
                    z.writestr(zipfile.ZipInfo(member), content.as_py())
                    n += 1
        return pa.table({"archive": [table.column("archive")[0].as_py()], "n_members": pa.array([n], pa.int64()), "content": pa.array([out.getvalue()], pa.binary())})

    return kept.select("archive", "member", "member_ord", "content", "__gone").groupBy("archive").applyInArrow(build, "archive string, n_members long, content binary")


def zip_rows(rows: DataFrame, archive: Column, member: Column, content: Column) -> DataFrame:
    """``(path, content)``: rows gathered into one ZIP for each value of ``archive``."""
    keyed = rows.select(archive.alias("archive"), member.alias("member"), content.cast("binary").alias("content"))

    def build(table: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for m, c in sorted(zip(table.column("member").to_pylist(), table.column("content").to_pylist(), strict=True)):
                z.writestr(zipfile.ZipInfo(m), c or b"")
        return pa.table({"path": [table.column("archive")[0].as_py()], "content": pa.array([out.getvalue()], pa.binary())})

    return keyed.groupBy("archive").applyInArrow(build, "path string, content binary")
