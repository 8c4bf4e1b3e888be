"""Where intermediate tables live.

A long plan is cut by writing a table to the folder that the cluster names in
``spark.checkpoint.dir`` and reading it back: the rows then outlive any executor,
and later stages read only the columns they need. Such tables stay until ``sweep``
removes them, or from the start until the end of a ``scratch`` block.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder that the session names.

    Where it names none, a session in one process (``local``) gets a folder of its own;
    on a cluster no folder of one machine would do, and an error says what to set.
    """
    found = spark.conf.get(_CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CONF} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_CONF, found)
    return found.rstrip("/")


def _made(spark: SparkSession) -> list[str]:
    """The session's tables, oldest first."""
    if not hasattr(spark, "_kindred_tables"):
        spark._kindred_tables = []
    return spark._kindred_tables


def sweep(spark: SparkSession, first: int = 0) -> None:
    """Remove what this session has written under paths of ``fresh_path``, from the ``first`` on, once no result needs them."""
    made = _made(spark)
    _remove(spark, made[first:])
    del made[first:]


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` returned, once what was made of them is written."""
    for table in tables:
        discard_path(table.sparkSession, getattr(table, "_kindred_path", None))


def discard_path(spark: SparkSession, path: str | None) -> None:
    """Remove what was written under a path of ``fresh_path``; others stay."""
    if path in _made(spark):
        _made(spark).remove(path)
        _remove(spark, [path])


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove at the end of the block what ``materialise`` wrote in it; for blocks whose results are written or collected within."""
    first = len(_made(spark))
    try:
        yield
    finally:
        sweep(spark, first)


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that no other call gets, and that ``sweep`` removes."""
    path = f"{shared_dir(spark)}/kindred/{tag}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def materialise(df: DataFrame, tag: str = "table", compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "_kindred_path", path)
    return out
