"""Which member of a group stays, and plans for the others. Plans are tables; nothing is changed on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions.scalars import file_name, parent, renamed
from kindred.plans.order import group_rank
from kindred.plans.storage import materialise


def _best(use_mtime: bool) -> Column:
    """The key that is smallest for the best row: pixels, size, newest time (none is oldest), then input order."""
    pixels = F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0)).cast("long")
    newest = [F.col("mtime").isNull(), -F.coalesce(F.col("mtime").cast("double"), F.lit(0.0))] if use_mtime else []
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate((-pixels, -F.coalesce("length", F.lit(0)), *newest, F.col("ord")))])


def keep_best(members: DataFrame, group: str = "group_id", use_mtime: bool = True) -> DataFrame:
    """The best row of each group: pixels, size, newest time, then input order. Only each task's best of a group is shuffled."""
    row = F.struct(*[F.col(f"`{c}`") for c in members.columns])
    return members.groupBy(F.col(group).alias("__g")).agg(F.min_by(row, _best(use_mtime)).alias("__row")).select("__row.*")


def duplicates(members: DataFrame, group: str = "group_id", use_mtime: bool = True) -> DataFrame:
    """All rows but the best; ``ord`` tells the rows of a group apart, so no task sees a group whole."""
    best = members.groupBy(F.col(group).alias("__g")).agg(F.min(_best(use_mtime)).alias("__b"))
    best = best.select("__g", F.col("__b")[f"k{4 if use_mtime else 2}"].alias("__o"))
    return members.join(best, members[group].eqNullSafe(best["__g"]) & (members["ord"] == best["__o"]), "left_anti")


def ranked(members: DataFrame, group: str = "group_id", use_mtime: bool = True) -> DataFrame:
    """``rank`` within each group, the best first."""
    return group_rank(members.withColumn("__k", _best(use_mtime)), "rank", [group], F.asc("__k")).drop("__k")


def delete_plan(members: DataFrame, group: str = "group_id") -> DataFrame:
    """``(group_id, n_delete, bytes_reclaimed)`` if all but the best go; groups of one have no row."""
    sizes = members.groupBy(group).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.min_by("length", _best(True)).alias("best"))
    return sizes.filter("n > 1").select(group, (F.col("n") - 1).alias("n_delete"), (F.col("bytes") - F.coalesce("best", F.lit(0))).alias("bytes_reclaimed"))


def _parts(name: Column) -> tuple[Column, Column]:
    """A name before its last suffix, and that suffix with its dot; a leading or trailing dot begins none."""
    tail = F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)
    return name.substr(F.lit(1), F.length(name) - F.length(tail)), tail


def unique_targets(wanted: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(ord, path, target)`` from ``(ord, path, dir, name)``: names that clash get _1, _2, and so on, the smallest number that is free.

    ``existing`` holds names already there as ``dir, name``, repeated or not. A name as
    it is wanted goes to the first row by ``ord``, before any with a number; numbered
    names of different stems can't meet. So the k-th row that waits for a name takes the
    k-th gap between the numbers that are taken, which is its place among waiting rows
    and taken numbers together. Places come from ``group_rank``: a name that very many
    rows want, or that has very many numbers, is spread over tasks.
    """
    key = ["dir", "head", "tail"]
    rows = wanted.select("ord", "path", "dir", "name", *[c.alias(a) for c, a in zip(_parts(F.col("name")), key[1:], strict=True)])
    taken = rows.select("dir", "name").limit(0) if existing is None else existing.select("dir", "name").distinct()
    first = materialise(rows.groupBy("dir", "name").agg(F.min("ord").alias("__o")).join(taken, ["dir", "name"], "left_anti"), "names")
    own = F.col("ord") == F.col("__o")
    placed = rows.join(first.select("__o"), own, "left_semi")
    waiting = materialise(rows.join(first.select("__o"), own, "left_anti"), "waiting")
    head, tail = _parts(F.col("name"))
    numbered = taken.unionByName(first.select("dir", "name")).select("dir", head.alias("__h"), tail.alias("tail"))
    number = F.regexp_extract("__h", r"(?s)^.*_([1-9][0-9]{0,17})$", 1)
    numbered = numbered.filter(number != "").select("dir", F.col("__h").substr(F.lit(1), F.length("__h") - F.length(number) - 1).alias("head"), "tail", number.cast("long").alias("__k")).distinct()
    numbered = group_rank(numbered.join(waiting.select(*key).distinct(), key, "left_semi"), "__i", key, F.asc("__k"))
    queue = group_rank(waiting, "__j", key, F.asc("ord"))
    # A number k that is the i-th taken has k - i gaps before it; it comes before the next gap's row.
    gap = numbered.select(*key, (2 * (F.col("__k") - F.col("__i")) + 1).alias("__at"), F.lit(None).cast(rows.schema["ord"].dataType).alias("ord"), F.lit(None).cast("string").alias("path"))
    events = gap.unionByName(queue.select(*key, (2 * F.col("__j")).alias("__at"), "ord", "path"))
    given = group_rank(events, "__n", key, F.asc("__at")).filter("ord is not null")
    named = given.select("ord", "path", "dir", F.concat("head", F.lit("_"), F.col("__n").cast("string"), "tail").alias("name"))
    return placed.select("ord", "path", "dir", "name").unionByName(named).select("ord", "path", F.concat_ws("/", "dir", "name").alias("target"))


def move_plan(members: DataFrame, directory: str, group: str = "group_id", existing: DataFrame | None = None) -> DataFrame:
    """Where all but the best of each group go in one directory."""
    wanted = duplicates(members, group).select("ord", "path", F.lit(directory).alias("dir"), file_name(F.col("path")).alias("name"))
    return unique_targets(wanted, existing)


def rename_plan(members: DataFrame, prefix: str, start: int = 1, group: str = "group_id", existing: DataFrame | None = None) -> DataFrame:
    """``(group_id, ord, path, target)``: sequential names within each group, in input order, same directory.

    A name that ``existing`` (``dir, name``, repeated or not) holds already gets _1, _2,
    and so on; a file that bears its new name already keeps it.
    """
    named = group_rank(members.select(group, "ord", "path"), "index", [group], F.asc("ord"), first=start)
    name = renamed(F.concat(F.lit(prefix), F.col(group).cast("string")), F.col("index"), F.col("path"))
    wanted = named.withColumn("dir", parent(F.col("path"))).withColumn("name", name)
    if existing is None:
        return wanted.select(group, "ord", "path", F.concat_ws("/", "dir", "name").alias("target"))
    wanted = materialise(wanted, "renames")
    own = F.concat_ws("/", "dir", "name") == F.col("path")
    held = existing.select("dir", "name").unionByName(wanted.filter(own).select("dir", "name"))
    moved = unique_targets(wanted.filter(~own), held).select(F.col("ord").alias("__o"), "target")
    moved = wanted.filter(~own).join(moved, F.col("ord") == F.col("__o")).select(group, "ord", "path", "target")
    return moved.unionByName(wanted.filter(own).select(group, "ord", "path", F.col("path").alias("target")))


def remove_files(members: DataFrame, gone: DataFrame, group: str = "group_id", key: str = "path") -> DataFrame:
    """Without the given files, and without groups that have fewer than two left."""
    left = members.join(gone.select(key).distinct(), key, "left_anti")
    return left.join(left.groupBy(group).count().filter("count >= 2").select(group), group, "left_semi")


def apply_renames(members: DataFrame, plan: DataFrame) -> DataFrame:
    """Members under their new paths."""
    new = plan.select(F.col("ord").alias("__o"), F.col("target").alias("__t"))
    return members.join(new, members["ord"] == new["__o"], "left").withColumn("path", F.coalesce("__t", "path")).drop("__o", "__t")


def with_method(groups: DataFrame, method: str) -> DataFrame:
    return groups.filter(F.col("method") == method)


def with_similarity(groups: DataFrame, low: float, high: float) -> DataFrame:
    """Both ends included."""
    return groups.filter(F.col("similarity").between(low, high))


def search_members(members: DataFrame, text: str) -> DataFrame:
    """Members whose path contains ``text``, whatever its case; groups without any drop out."""
    return members.filter(F.contains(F.lower("path"), F.lit(text.lower())))


def preview(rows: DataFrame, n: int = 10) -> tuple[DataFrame, int]:
    """The first ``n`` paths and how many more there are."""
    total = rows.count()
    return rows.orderBy("ord").select("path").limit(n), max(0, total - n)


def sorted_results(groups: DataFrame, by: str = "similarity", descending: bool = True) -> DataFrame:
    """Groups by similarity, size or name, ties by number."""
    return groups.orderBy(F.desc(by) if descending else F.asc(by), "group_id")
