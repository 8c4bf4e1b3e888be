"""Toxic passages as maximum-scoring segments of token log-odds.

A word's weight is the log-odds ratio of toxic against clean labelled documents under
an informative Dirichlet prior (the words' shares in both together). Words whose ratio
stands out by several standard deviations, to either side, make the lexicon, with prefixes
as a back-off for compounds; every other word counts slightly against. One pass over a text finds all
maximal segments of positive total, each of which is longer or better than any way to
cut it. By chance alone the number of segments of total S in n words is about
K n exp(-lambda S): lambda is the root of the moment equation over clean words, K the
most likely one given the best segments of clean labelled documents. That gives every
passage a p-value; significant ones are reported, and a document's passages are taken
together by the law of the sum of the r best, whose smallest p-value over r is what a
logistic curve turns into the probability. The curve is fitted on labelled documents in
two folds, each scored by a model of the other, as a lexicon stands out most in the
documents that made it.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import map_rows, table
from kindred.plans.storage import materialise

#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of their ids.
MAX_LABELLED = 50_000
#: The prior's weight as a share of all counted words.
PRIOR_SHARE = 0.1
#: Standard deviations by which a lexicon entry's log-odds are off zero.
LEAST_Z = 3.0
#: Largest lexicon; the entries that stand out most stay.
MAX_LEXICON = 100_000
PREFIXES = (5, 6, 7)
#: Parts of the labelled documents; each is scored by a model of the others when the curve is fitted.
FOLDS = 2
#: Passages with a larger p-value are put down to chance.
ALPHA = 0.05
#: Weight of a word outside the lexicon.
OTHER = -0.2
_WORD = re.compile(r"[^\W\d_]+")


def entries(word: str) -> list[str]:
    """The lexicon keys of a word: itself, and its prefixes."""
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def maximal_segments(weights: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, last, total)`` of sparse weights, in linear time.

    ``weights`` are (position, weight) of the positions with a weight other than
    ``OTHER``, ascending. After Ruzzo and Tompa (1999): each positive run is merged
    leftwards with the nearest segment that starts lower, if that ends lower.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    below: list[int] = []  # for each, the nearest earlier one whose total before is less
    total, at = 0.0, 0
    for i, w in weights:
        total += OTHER * (i - at)
        first, last, left, right = i, i, total, total + w
        total, at = right, i + 1
        if w <= 0:
            continue
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = below[j]
            if j < 0 or found[j][3] >= right:
                found.append((first, last, left, right))
                below.append(j)
                break
            first, left = found[j][0], found[j][2]
            del found[j:], below[j:]
    return [(a, b, r - x) for a, b, x, r in found]


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    rate: float  # lambda of the extreme-value law
    k: float  # and its K
    intercept: float
    slope: float

    def weight(self, word: str) -> float:
        known = [w for e in entries(word) if (w := self.lexicon.get(e)) is not None]
        return max(known) if known else OTHER


class Scorer:
    """Scores texts with a model, remembering the weights of words within a bound."""

    KEPT = 300_000

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        words = _WORD.findall(text.lower())
        if len(self.known) > self.KEPT:
            self.known.clear()
        known, weight = self.known, self.model.weight
        sparse = []
        for i, w in enumerate(words):
            v = known.get(w)
            if v is None:
                v = known[w] = weight(w)
            if v != OTHER:
                sparse.append((i, v))
        return len(words), maximal_segments(sparse)

    def normalised(self, n: int, total: float) -> float:
        """``lambda S - log(K n)``: minus the log of how many segments like it are expected by chance."""
        return self.model.rate * total - math.log(self.model.k * max(n, 1))

    def p_value(self, n: int, total: float) -> float:
        """The chance of a best segment of ``total`` or more in ``n`` words."""
        return -math.expm1(-math.exp(-self.normalised(n, total)))

    def statistic(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        """Minus the log of the smallest p-value of the r best segments together, over all r.

        The sum t of r normalised totals exceeds t by chance with probability about
        ``exp(-t) t^(r-1) / (r! (r-1)!)`` (Karlin and Altschul, 1993), for t well over r.
        """
        values = sorted((self.normalised(n, s) for _, _, s in segments), reverse=True)
        best = -math.log(max(self.p_value(n, max((s for _, _, s in segments), default=0.0)), 1e-300))
        t, parts = 0.0, 0.0
        for r, x in enumerate(values, 1):
            if x <= 0:
                break
            t += x
            parts += math.log(r) + math.log(max(r - 1, 1))  # log r! + log (r-1)!
            if t > r * r:
                best = max(best, t - (r - 1) * math.log(t) + parts - math.log(r * (r + 1) / 2))
        return best

    def score(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        z = self.model.intercept + self.model.slope * self.statistic(n, segments)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int = MAX_LABELLED) -> dict[int, int]:
    """Up to ``most`` labelled ids; of repeated ones the largest label counts, rows with nulls don't."""
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter("i is not null and y is not null")
    rows = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(most).collect()
    return {r["i"]: r["y"] for r in rows}


def _word_counts(labelled: DataFrame) -> DataFrame:
    """``(entry, fold, toxic, clean)``: in how many of the ``text, y, fold`` rows of either class and each fold an entry occurs."""

    def run(batches):
        mine: dict[tuple[str, int], list[int]] = {}

        def flush():
            keys = list(mine)
            counts = np.array([mine[k] for k in keys], np.int64).reshape(-1, 2)
            mine.clear()
            return pa.RecordBatch.from_arrays([pa.array([e for e, _ in keys], pa.string()), pa.array([f for _, f in keys], pa.int64()), pa.array(counts[:, 1]), pa.array(counts[:, 0])], ["entry", "fold", "toxic", "clean"])

        for batch in batches:
            for text, y, fold in zip(batch.column("text"), batch.column("y").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                for e in {e for w in set(_WORD.findall((text.as_py() or "").lower())) for e in entries(w)}:
                    mine.setdefault((e, fold), [0, 0])[1 if y else 0] += 1
                if len(mine) > 200_000:
                    yield flush()
        if mine:
            yield flush()

    counted = labelled.select("text", "y", "fold").mapInArrow(run, "entry string, fold long, toxic long, clean long")
    return counted.groupBy("entry", "fold").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _root(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of ``sum(shares * exp(rate * weights)) = 1``, where it exists."""
    lo, hi = 1e-6, 50.0
    if float(shares @ weights) >= 0:
        return lo
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(shares @ np.exp(np.minimum(700, mid * weights))) < 1 else (lo, mid)
    return lo


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps with a small ridge on the slope."""
    a = np.stack([np.ones_like(x), x], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag([1e-6, ridge]), a.T @ (y - p) - np.array([0, ridge]) * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def fit(docs: DataFrame, labels: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from the documents whose ids are in ``labels`` (a bounded sample).

    The lexicon and at most one row of figures for each labelled document come to the
    driver. Without both classes nothing can be learnt: every score is then the share
    of toxic labels (0 if there are none).
    """
    toxic = sum(1 for y in labels.values() if y)
    if not toxic or toxic == len(labels):
        share = min(max((toxic + 1e-9) / (len(labels) + 1), 1e-6), 1 - 1e-6)
        return Model({}, 1.0, 1.0, math.log(share / (1 - share)), 0.0)
    known = docs.sparkSession.createDataFrame(list(labels.items()), "doc_id long, y int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(FOLDS)), F.lit(FOLDS)).cast("long").alias("fold")
    labelled = materialise(rows.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y", fold), "labelled")  # the labels are a bounded sample
    counts = materialise(_word_counts(labelled), "words")
    whole = _law(labelled, counts, labels)
    if whole is None:
        return Model({}, 1.0, 1.0, math.log(toxic / (len(labels) - toxic)), 0.0)
    parts = [(f, _law(labelled.filter(F.col("fold") != f), counts.filter(F.col("fold") != f), labels)) for f in range(FOLDS)]
    if any(law is None for _, law in parts):  # a fold without one of the classes
        parts = [(None, whole)]
    x, y = [], []
    for f, law in parts:
        of_fold = labelled if f is None else labelled.filter(F.col("fold") == f)
        for r in score(of_fold, law).groupBy("doc_id").agg(F.max("statistic").alias("statistic")).collect():
            x.append(r["statistic"])
            y.append(float(labels[r["doc_id"]] > 0))
    return replace(whole, **dict(zip(("intercept", "slope"), _logistic(np.array(x), np.array(y)), strict=True)))


def _law(labelled: DataFrame, counts: DataFrame, labels: dict[int, int]) -> Model | None:
    """Lexicon, lambda and K from labelled documents and the counts of their entries; None without words of both classes."""
    counts = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n1, n0 = (float(v or 0) for v in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n1 or not n0:
        return None
    prior = PRIOR_SHARE * (n1 + n0)
    a = (F.col("toxic") + F.col("clean")) * PRIOR_SHARE
    odds = lambda y, n: F.log((y + a) / (n + prior - y - a))
    delta = odds(F.col("toxic"), n1) - odds(F.col("clean"), n0)
    z = delta / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    off = F.abs("z")
    rows = counts.select("entry", "clean", delta.alias("weight"), z.alias("z")).filter(off > LEAST_Z).orderBy(off.desc(), "entry").limit(MAX_LEXICON).collect()
    lexicon = {r["entry"]: r["weight"] for r in rows}
    # Clean words by weight, a word standing for its own entry: the moment equation needs only their shares.
    plain = [(r["weight"], r["clean"] + 0.5) for r in rows if not r["entry"].startswith("^")]
    weights = np.array([w for w, _ in plain] + [OTHER])
    mass = np.array([c for _, c in plain] + [max(n0 - sum(c for _, c in plain), 1.0)])
    rough = Model(lexicon, _root(weights, mass / mass.sum()), 1.0, 0.0, 1.0)
    best = score(labelled, rough).groupBy("doc_id").agg(F.max(F.struct("best", "n_words")).alias("b")).collect()
    return replace(rough, k=_most_likely_k(rough.rate, [(r["b"]["n_words"], r["b"]["best"]) for r in best if not labels[r["doc_id"]]]))


def _most_likely_k(rate: float, clean: list[tuple[int, float]]) -> float:
    """K of the law ``P(best < S) = exp(-K n exp(-rate S))``, given the lengths and best totals of clean documents."""
    return len(clean) / max(math.fsum(max(n, 1) * math.exp(-rate * s) for n, s in clean), 1e-300) if clean else 1.0


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, best, statistic, score, passages)`` for every row, without a shuffle.

    ``passages`` are the maximal segments ``(first, last, total, p_value)`` in word
    positions whose p-value is ``ALPHA`` or less, ``best`` the largest total of any.
    Null and empty texts have no words: they get the score of a text in which nothing
    stands out. Every row keeps its own result; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("total", pa.float64()), ("p_value", pa.float64())]))

    def make():
        scorer = Scorer(shared.value)

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scorer.segments(t or "") for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([max((s for _, _, s in x), default=0.0) for _, x in found], pa.float64()),
                pa.array([scorer.statistic(*f) for f in found], pa.float64()), pa.array([scorer.score(*f) for f in found], pa.float64()),
                pa.array([[{"first": a, "last": b, "total": s, "p_value": p} for a, b, s in segments if (p := scorer.p_value(n, s)) <= ALPHA] for n, segments in found], kind),
            ], ["doc_id", "n_words", "best", "statistic", "score", "passages"])

        return kernel

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, n_words long, best double, statistic double, score double, passages array<struct<first:long,last:long,total:double,p_value:double>>")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels outside the held-out third.

    Null and empty texts get the score of a text in which nothing stands out; a null id
    is never held out, nor learnt from; repeated rows keep their own results.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = fit(docs, labelled_sample(labels.filter(~held_out), "doc_id", "toxic"))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
