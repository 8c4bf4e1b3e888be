"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Rows that a kernel turns into Python objects at once.
SLICE_ROWS = 512
#: Characters after which a slice ends early, so that very long texts don't pile up.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, text: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each cut holds a bounded number of rows and characters (one row at least)."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: StructType | str, text: str = "text", rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` over slices: ``make`` runs once in each task and returns the kernel.

    Workers outlive their tasks, so a task's free Arrow memory goes back before the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch, text, rows):
                yield kernel(part)
            batch = part = None
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The text column as Python strings; null reads as empty."""
    return [t or "" for t in batch.column(text).to_pylist()]


def whole_text(df: DataFrame, text_col: str = "text") -> F.Column:
    return F.coalesce(F.col(text_col), F.lit(""))
