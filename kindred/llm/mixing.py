"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies. Among all rates between
0 and ``most`` whose words add up to the target of each source, the chosen ones have
the least relative entropy to "every document once". That convex problem has one dual
variable for each source, and its solution is an exponential tilt by the document's
size, ``rate / (most - rate) = exp(tilt * size / mean size) / (most - 1)``. Newton's
method finds all tilts at once; every iteration is one join and one aggregation over
the table of (source, size, count), which stands for the documents exactly.

The rates of one source depend on the size alone, so systematic rounding needs only
each document's rank among those of its source and size: the running total of the
fractions over sizes, largest first, comes from the same small table. The words taken
then differ from the target by at most the largest document or so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kindred.llm.common import table
from kindred.plans.order import global_rank
from kindred.plans.storage import discard, materialise

#: No document is taken more often, and no target exceeds this multiple of its source.
MOST = 3
#: Documents of one source and size are ranked within this many hash buckets, then across them.
RANK_BUCKETS = 1024
TOLERANCE = 1e-9
MAX_STEPS = 80
#: Steps between two writes of the tilts.
STEPS_A_JOB = 2
#: Systematic rounding tries this many starts for each source and keeps the one whose words come nearest.
STARTS = 16
#: A dual step is no longer than this (in units of 1 / mean size).
LONGEST_STEP = 4.0


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_hash(rows: DataFrame) -> Column:
    """A hash of all columns; maps, which have no hash of their own, count by their JSON text."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in rows.schema]
    return F.xxhash64(*plain)


def _key(source: Column) -> Column:
    """Orders as code points do, null last, and is never null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: DataFrame, most: float = MOST) -> DataFrame:
    """``(key, source_size, n, target)``: weights 1, 2, 3 repeat over the sorted sources.

    Sharing the excess of capped sources by weight, again and again, ends where
    ``target = min(most * source_size, level * weight)`` adds up to all words. The level
    is found as that sharing goes, by an aggregation over the sources for each turn, of
    which one row comes to the driver: the sum is concave and made of straight lines, so
    few turns are needed and the last one is exact.
    """
    sources = sizes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n"))
    ranked = global_rank(sources, "place", F.asc("key"), first=0)
    ranked = materialise(ranked.select("key", "source_size", "n", (F.col("place") % 3 + 1).alias("weight"), (most * F.col("source_size").cast("double")).alias("cap")), "sources")
    level = 0.0
    while True:
        over = F.col("cap") <= level * F.col("weight")
        words, full, weight = ranked.agg(F.sum("source_size"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        last, level = level, (words - full) / weight if words and weight else level
        if level <= last:
            break
    return ranked.select("key", "source_size", "n", F.least("cap", level * F.col("weight")).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, most: float) -> Column:
    odds = F.exp(F.least(F.lit(700.0), tilt * size / mean)) / (most - 1)
    return most * odds / (1 + odds)


def tilts(sizes: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """``(key, source_size, target, mean, tilt, full)``: the dual solution for every source.

    Newton steps on the convex dual, kept inside the bracket that the signs of the
    gradient have shown; only one row of convergence figures reaches the driver.
    """
    state = goals.select("key", "source_size", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)).alias("full"), F.lit(None).cast("double").alias("gap"))
    state = materialise(state, "tilts")
    open_ = (~F.col("full")) & (F.col("source_size") > 0)

    def step(state: DataFrame) -> DataFrame:
        r, words, x = F.col("rate"), F.col("n") * F.col("size"), F.col("size") / F.col("mean")
        at = sizes.join(state.filter(open_), "key").withColumn("rate", _rate(F.col("tilt"), F.col("size"), F.col("mean"), most))
        sums = at.groupBy("key").agg(F.sum(words * r).alias("got"), F.sum(words * x * r * (1 - r / most)).alias("slope"))
        gap = F.col("got") - F.col("target")
        moved = state.drop("gap").join(sums, "key", "left").withColumn("gap", F.abs(gap) / F.greatest("target", F.lit(1.0)))
        moved = moved.withColumn("lo", F.when(gap <= 0, F.col("tilt")).otherwise(F.col("lo"))).withColumn("hi", F.when(gap >= 0, F.col("tilt")).otherwise(F.col("hi")))
        jump = F.greatest(F.lit(-LONGEST_STEP), F.least(F.lit(LONGEST_STEP), -gap / F.greatest("slope", F.lit(1e-300))))
        aim = F.col("tilt") + jump
        inside = (F.col("lo").isNull() | (aim > F.col("lo"))) & (F.col("hi").isNull() | (aim < F.col("hi")))
        settled = F.col("gap").isNull() | (F.col("gap") <= TOLERANCE)
        return moved.withColumn("tilt", F.when(settled, F.col("tilt")).when(inside, aim).otherwise((F.col("lo") + F.col("hi")) / 2)).select(state.columns)

    for _ in range(MAX_STEPS // STEPS_A_JOB):
        known = state
        for _ in range(STEPS_A_JOB):
            state = step(state)
        state = materialise(state, "tilts")
        discard(known)
        if (state.agg(F.max("gap")).first()[0] or 0) <= TOLERANCE:
            break
    return state.select("key", "source_size", "target", "mean", "tilt", "full")


def _best_start(rated: DataFrame) -> DataFrame:
    """``(key, start)``: exact words taken for each start, from the table of sizes alone."""
    starts = [(k + 0.5) / STARTS for k in range(STARTS)]
    taken = [F.sum(F.col("size") * (F.col("n") * F.col("whole") + F.floor(F.col("offset") + F.col("n") * F.col("part") + u) - F.floor(F.col("offset") + u))) for u in starts]
    off = F.array(*[F.struct(F.abs(t - F.first("target")).alias("off"), F.lit(u).alias("start")) for t, u in zip(taken, starts, strict=True)])
    return rated.groupBy("key").agg(F.array_min(off)["start"].alias("start"))


def mix(rows: DataFrame, id_col: str, source_col: str, size: Column, most: float = MOST) -> DataFrame:
    """Every row with ``source_size``, ``target``, ``rate`` and ``copies``, the number of times the mix takes it.

    The row itself comes back whole in the struct column ``row``, so its column names
    can't clash. A null source is a source of its own, last in order; rows without words
    are taken once and weigh nothing; repeated ids are rows like any other, told apart
    by a hash of the whole row, and equal rows are interchangeable; an empty table gives
    no rows. Equal input gives equal copies on every run, however it is dealt.
    """
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), _key(F.col(source_col)).alias("key"), size.alias("size"), F.col(id_col).cast("long").alias("own"), row_hash(rows).alias("tie"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("own", "tie"), F.lit(RANK_BUCKETS)))
    buckets = materialise(keyed.groupBy("key", "size", "bucket").agg(F.count("*").alias("n")), "sizes")
    sizes = materialise(buckets.groupBy("key", "size").agg(F.sum("n").alias("n")), "sizes")
    solved = tilts(sizes, targets(sizes, most), most)
    rate = F.when(F.col("source_size") == 0, 1.0).when(F.col("full"), float(most)).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), most))
    rated = sizes.join(solved, "key").withColumn("rate", F.round(rate, 12)).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    larger = W.partitionBy("key").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    rated = rated.withColumn("offset", F.coalesce(F.sum(F.col("n") * F.col("part")).over(larger), F.lit(0.0)))
    rated = rated.join(_best_start(rated), "key").drop("n")
    earlier = W.partitionBy("key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    placed = buckets.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").join(rated, ["key", "size"])
    placed = materialise(placed.select("key", "size", "bucket", "earlier", "offset", "start", "part", "whole", "rate", "source_size", "target"), "rates")
    ranked = keyed.withColumn("nth", F.row_number().over(W.partitionBy("key", "size", "bucket").orderBy("own", "tie")))
    out = ranked.join(placed, ["key", "size", "bucket"])
    upto = F.col("offset") + (F.col("earlier") + F.col("nth")) * F.col("part") + F.col("start")
    copies = F.col("whole") + F.floor(upto) - F.floor(upto - F.col("part"))
    return out.select("row", "source_size", "target", "rate", F.least(copies, F.lit(int(most))).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``mix`` of documents by their number of words; ``(doc_id, size, source_size, target, rate, copies)``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_hash(docs).alias("tie"))
    return mix(materialise(rows, "words"), "doc_id", "source", F.col("size")).select("row.doc_id", "row.size", "source_size", "target", "rate", "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: every row as often as it is taken, with its own columns; rows not taken are left out."""
    found = mix(docs, id_col, source_col, word_count(F.col(text_col))).filter("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's target and the words of it that the mix takes."""
    found = mix_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
