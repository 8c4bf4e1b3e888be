"""A quality classifier by importance resampling.

Texts are bags of hashed word n-grams. Two generative models over the same buckets,
one of the target (documents labelled good), one of the raw collection (all documents),
give each document the log of its importance weight, the summed log-ratio of its
n-grams. Documents are then sampled without replacement in proportion to the weights:
each gets its log-weight plus Gumbel noise, and the k largest are kept. k is not a
fixed quota: it is the number of documents whose weight passes the threshold that
separates the labelled documents best, each weighed by models without it, so a clean
collection is kept whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import map_rows, slices, table, texts
from kindred.llm.toxicity import labelled_sample
from kindred.plans.storage import materialise

BUCKETS = 16_384
#: Labelled rows in use, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 50_000
#: Occurrences added to either model's buckets, in units of the target's size. Of 1, 3, 10 and 30 this one ordered left-out documents best.
SMOOTHING = 30.0
#: The log-weight is divided by this before the noise is added: 1 samples in proportion to the importance weights, less comes closer to a plain cut.
TEMPERATURE = 1.0
SEED = 17
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_STEP, _SAME = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


def buckets_of(text: str, size: int = BUCKETS) -> np.ndarray:
    """Buckets of a text's tokens and token pairs; a token after itself is one feature whatever it is."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    pairs = h[:-1] * _STEP + h[1:]
    pairs[h[:-1] == h[1:]] = _SAME
    both = np.concatenate([h, pairs])
    return ((both ^ (both >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def gumbel(doc_id: int | None, text: str, seed: int = SEED) -> float:
    """Noise that depends on the row alone, so that reruns and recomputed tasks agree."""
    h = xxhash.xxh3_64_intdigest(f"{doc_id}\n{text}".encode("utf-8", "surrogatepass"), seed=seed)
    return -math.log(-math.log(((h >> 11) + 0.5) / (1 << 53)))


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray  # log of target over raw, for each bucket
    threshold: float = 0.0

    def weight(self, text: str) -> tuple[int, float]:
        """Number of n-grams, and the log of the importance weight."""
        b = buckets_of(text, len(self.ratio))
        return len(b), float(self.ratio[b].sum())


def left_out(raw: np.ndarray, target: np.ndarray, text: str, good: bool) -> float:
    """A labelled document's log-weight by models of all others."""
    b, own = np.unique(buckets_of(text, len(raw)), return_counts=True)
    share = target.sum() / max(raw.sum(), 1.0)
    return float(own @ _ratio(raw[b] - own, target[b] - own * good, share))


def _ratio(raw: np.ndarray, target: np.ndarray, share: float) -> np.ndarray:
    return np.log((target + SMOOTHING) / (raw * share + SMOOTHING))


def _counts(docs: DataFrame, good: set[int], id_col: str, text_col: str, size: int) -> DataFrame:
    """``(bucket, raw, target)`` summed over all documents; every task adds up its own first."""
    shared = docs.sparkSession.sparkContext.broadcast(good)

    def run(batches):
        raw, target, known = np.zeros(size, np.int64), np.zeros(size, np.int64), shared.value
        for batch in batches:
            for cut in slices(batch):
                for d, t in zip(cut.column("doc_id").to_pylist(), cut.column("text").to_pylist(), strict=True):
                    b = buckets_of(t or "", size)
                    np.add.at(raw, b, 1)
                    if d in known:
                        np.add.at(target, b, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """``(doc_id, n_grams, log_weight, draw)`` for every row; ``draw`` is the perturbed weight that is ranked."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [(*m.weight(t or ""), gumbel(d, t or "")) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            n, w, g = (np.array(c) for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(w.astype(float)), pa.array(w / temperature + g)], ["doc_id", "n_grams", "log_weight", "draw"])

        return kernel

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, n_grams long, log_weight double, draw double")


def _best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest errors among labelled rows, a rejected good one counting twice; the lowest such cut."""
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)])  # good ones below the cut
    let = (len(g) - g.sum()) - np.concatenate([[0], np.cumsum(~g)])  # bad ones above it
    cost = (2 * lost + let).astype(float)
    cost[1:-1][s[1:] == s[:-1]] = np.inf  # no cut between equal scores
    i = int(np.argmin(cost))
    if i == 0:
        return -math.inf
    return math.inf if i == len(s) else float(s[i - 1] + s[i]) / 2


def kth_largest(draws: DataFrame, k: int, column: str = "draw", bins: int = 1024, few: int = 10_000) -> float:
    """The k-th largest value, exactly: histograms narrow its bin down until few values are left."""
    finite = draws.select(F.col(column).alias("v"))
    lo, hi = finite.agg(F.min("v"), F.max("v")).first()
    above = 0  # values over hi
    for _ in range(12):
        within = finite.filter((F.col("v") >= lo) & (F.col("v") <= hi))
        width = (hi - lo) / bins
        if not width or lo + width == lo:
            break
        at = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))
        held = {r["bin"]: (r["n"], r["least"], r["most"]) for r in within.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")).collect()}
        for b in sorted(held, reverse=True):
            n, least, most = held[b]
            if above + n >= k:
                lo, hi = least, most
                break
            above += n
        if n <= few:
            rows = finite.filter((F.col("v") >= lo) & (F.col("v") <= hi)).collect()
            return sorted((r["v"] for r in rows), reverse=True)[k - above - 1]
    return lo


@dataclass(frozen=True)
class Decision:
    model: Model
    cut: float  # rows whose draw is at least this are kept
    kept: int


def decide(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", temperature: float = TEMPERATURE) -> tuple[Decision, DataFrame]:
    """Fit both models, score every row and find the sample; also the scored rows (``weights``).

    Without good and bad labels there is nothing to tell apart, and all rows are kept.
    """
    known = labelled_sample(labels, "doc_id", label_col, MAX_LABELLED)
    good = {d for d, y in known.items() if y}
    rows = _counts(docs, good, id_col, text_col, BUCKETS).collect()  # one for each bucket
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    share = target.sum() / max(raw.sum(), 1.0)
    model = Model(_ratio(raw, target, share) if share else np.zeros(BUCKETS))
    scored = materialise(weights(docs, model, id_col, text_col, temperature), "weights")
    if len({bool(y) for y in known.values()}) < 2:
        return Decision(model, -math.inf, scored.count()), scored
    shared = docs.sparkSession.sparkContext.broadcast((raw, target))

    def run(batches):
        for batch in batches:
            for cut in slices(batch):
                found, n, w = texts(cut), [], []
                for t, y in zip(found, cut.column("good").to_pylist(), strict=True):
                    n.append(1 if _TOKEN.search(t) else 0)
                    w.append(left_out(*shared.value, t, y))
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), cut.column("good"), pa.array(n, pa.int64()), pa.array(w, pa.float64())], ["doc_id", "good", "n", "log_weight"])

    sample = docs.sparkSession.createDataFrame([(d, bool(y)) for d, y in known.items()], "doc_id long, good boolean")
    labelled = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    seen = labelled.mapInArrow(run, "doc_id long, good boolean, n long, log_weight double").filter("n > 0").groupBy("doc_id").agg(F.min("log_weight").alias("log_weight"), F.max("good").alias("good")).toPandas()  # a row for each of the labelled sample at most
    model = Model(model.ratio, _best_threshold(seen["log_weight"].to_numpy(float), seen["good"].to_numpy(bool)))
    k = scored.filter(F.col("log_weight") >= model.threshold).count()
    cut = kth_largest(scored, k) if k else math.inf
    return Decision(model, cut, k), scored


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``(doc_id, n_grams, log_weight, draw, keep)`` for every row.

    Null and empty texts have no n-grams and log-weight 0. Equal rows share one draw, so
    they are kept or rejected together; an empty table gives no rows.
    """
    decision, scored = decide(docs, labels, id_col, text_col, **how)
    return scored.withColumn("keep", F.col("draw") >= decision.cut)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """The rows that ``classify`` keeps, with all their columns; each row's draw is computed anew, nothing is joined."""
    decision, _ = decide(docs, labels, id_col, text_col, temperature=temperature)
    shared = docs.sparkSession.sparkContext.broadcast(decision)

    def make():
        d = shared.value

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, found = batch.column(id_col).to_pylist(), batch.column(text_col).to_pylist()
            return batch.filter(pa.array([d.model.weight(t or "")[1] / temperature + gumbel(i, t or "") >= d.cut for i, t in zip(ids, found, strict=True)], pa.bool_()))

        return kernel

    return map_rows(docs, make, docs.schema, text_col)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Every document with its importance weight and whether the sample keeps it."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
