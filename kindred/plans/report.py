"""Report tables of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred.functions import scalars as S
from kindred.operators.groups import method_rank
from kindred.plans.options import ScanOptions


def summary(groups: DataFrame) -> DataFrame:
    """``(method, n_groups, n_files)`` for each method that has groups, with its place in the report."""
    out = groups.groupBy("method").agg(F.count("*").alias("n_groups"), F.sum("n_files").alias("n_files"))
    return out.select(method_rank(F.col("method")).cast("long").alias("place"), "method", "n_groups", "n_files")


def totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"))


def details(members: DataFrame) -> DataFrame:
    """One display row for each member of each group, with the numbers as text."""
    return members.select(
        "group_id", S.method_label(F.col("method"), F.col("multi_account")).alias("label"), S.percent_text(F.col("similarity")).alias("similarity"),
        S.file_name(F.col("path")).alias("name"), S.shorten_path(F.col("path")).alias("path"), S.human_size(F.col("length")).alias("size"), S.dimensions_text(F.col("width"), F.col("height")).alias("dimensions"),
    )


def archive_report(groups: DataFrame, files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``(archive, total_files, n_groups, n_duplicates, high_share, alarm)`` for every archive of ``files``.

    ``n_duplicates`` counts a file once for each group it is in. The alarm is on if more
    than the allowed share of files is in groups of high similarity; never without files.
    """
    total = files.groupBy("archive").agg(F.count("*").alias("total_files"))
    high = F.sum(F.when(F.col("similarity") >= options.alarm_similarity, F.col("n_files")).otherwise(0))
    found = groups.groupBy("archive").agg(F.count("*").alias("n_groups"), F.sum("n_files").alias("n_duplicates"), high.alias("high"))
    out = total.join(found, "archive", "left").na.fill(0, ["n_groups", "n_duplicates", "high"])
    share = F.when(F.col("total_files") > 0, F.col("high") / F.col("total_files")).otherwise(0.0)
    return out.select("archive", "total_files", "n_groups", "n_duplicates", share.alias("high_share"), (share > options.alarm_share).alias("alarm"))


def archive_groups(groups: DataFrame, members: DataFrame) -> DataFrame:
    """``(archive, group_id, similarity, files)``: each group with its paths in order."""
    paths = members.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "path"))), lambda s: s["path"]).alias("files"))
    return groups.join(paths, "group_id").select("archive", "group_id", "similarity", "files")


def archive_log(report: DataFrame) -> DataFrame:
    """Rows for the log of archive scans."""
    return report.select(F.col("archive").alias("archive_path"), F.current_date().alias("scan_date"), "total_files", F.col("n_groups").alias("duplicate_groups"), F.col("high_share").alias("high_sim_pct"), F.current_timestamp().alias("created_at"))


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("stage", "error_type").agg(F.count("*").alias("n"))


def write_report(table: DataFrame, path: str, form: str = "parquet", by: str | None = None) -> None:
    """Parquet, CSV or JSON; ``by`` makes one folder for each value, dealt so that each has few files."""
    writer = (table.repartition(by) if by else table).write.mode("overwrite").format(form)
    if form == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(by) if by else writer).save(path)
