"""A data source that lists files in tasks, files without any bytes included.

Spark's own file sources leave empty files out before a query sees them, so a scan could
never report one. This source walks folders with Arrow's file systems: the driver goes
down until there are enough folders to deal out, tasks walk what is below them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "kindred_files"
#: Folders after which the driver goes no further down.
FOLDERS = 256
_ROWS = 10_000


class Folder(InputPartition):
    """A folder to walk, or one to list without what is below it, or a single file."""

    def __init__(self, path: str, deep: bool) -> None:
        super().__init__(path)
        self.path, self.deep = path, deep


class FileReader(DataSourceReader):
    def __init__(self, uri: str, folders: int) -> None:
        self.uri, self.folders = uri.rstrip("/") or "/", folders

    def _open(self) -> tuple[pafs.FileSystem, str, str]:
        """The file system, the path in it, and what stands before such paths in addresses."""
        found, base = pafs.FileSystem.from_uri(self.uri)
        base = base.rstrip("/") or "/"
        return found, base, self.uri[: -len(base)] if self.uri.endswith(base) else ""

    def partitions(self) -> list[Folder]:
        store, base, _ = self._open()
        if store.get_file_info(base).type != pafs.FileType.Directory:
            return [Folder(base, True)]
        flat, waiting = [], [base]
        while waiting and len(flat) + len(waiting) < self.folders:
            at = waiting.pop(0)
            flat.append(Folder(at, False))
            waiting += [i.path for i in store.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.Directory]
        return flat + [Folder(w, True) for w in waiting]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, _, before = self._open()
        top = store.get_file_info(partition.path)
        found = store.get_file_info(pafs.FileSelector(partition.path, recursive=partition.deep)) if top.type == pafs.FileType.Directory else [top]
        files = [i for i in found if i.type == pafs.FileType.File]
        for lo in range(0, len(files), _ROWS):
            part = files[lo : lo + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([before + i.path for i in part]), pa.array([i.size or 0 for i in part], pa.int64()), pa.array([i.mtime for i in part], pa.timestamp("us", "UTC"))], ["path", "length", "mtime"])


class FileListing(DataSource):
    """``path, length, mtime`` of all files at or under the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, length long, mtime timestamp"

    def reader(self, schema) -> FileReader:
        return FileReader(self.options["path"], int(self.options.get("folders", FOLDERS)))


def every_file(spark: SparkSession, path: str, folders: int = FOLDERS) -> DataFrame:
    """``path, length, mtime`` of all files at or under a path, empty ones included; a path that isn't there has none."""
    spark.dataSource.register(FileListing)
    return spark.read.format(NAME).option("folders", folders).load(path)
