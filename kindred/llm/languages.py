"""Languages of texts by Kneser-Ney character models.

Each language has a model of the next character given the four before it, interpolated
over all orders: the highest order counts occurrences, the lower ones count the
different characters that come before. Counts are taken over all labelled documents in
one Spark aggregation; a model is a few sorted arrays of 64-bit hashes, with a
probability for each n-gram and a back-off weight for each context, or, where all n-grams
together would be too many for one process, tables of the same. A text gets the
language with the lowest cross-entropy per character. On labelled documents that their
models have not seen two things are calibrated: the temperature that makes the
differences of cross-entropies probabilities, and how far over its usual value a text's
cross-entropy may lie, given the text's length, before the language is rejected.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from kindred.llm.common import slices, table
from kindred.plans.joins import join_counted
from kindred.plans.storage import materialise

ORDER = 5
#: n-grams of the highest order that models in memory hold together, at most; where there are more, the models are tables (``Tables``) and texts are joined with them.
MAX_GRAMS = 4_000_000
#: Temperatures to choose from.
TEMPERATURES = [2.0**k for k in range(16)]
#: The share of documents in their own language whose language is rejected.
ALPHA = 0.001
UNKNOWN = "und"
SLICE_ROWS = 128
#: Bytes of text after which a slice ends early.
SLICE_BYTES = 1_000_000
#: n-grams whose probabilities a task keeps at once, of up to four languages; of more languages fewer.
KEPT = 1_000_000
#: n-grams whose counts a task keeps at once, and those that it hands over at once.
COUNTED, SENT = 400_000, 50_000
_BLANK = 32
_STEPS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(ORDER)]


@lru_cache(maxsize=1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its symbol (letters in lower case and marks, else 0), and whether it is a letter."""
    symbols, letters = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            symbols[i], letters[i] = ord(low) if len(low) == 1 else i, True
        elif i > 127 and unicodedata.category(c)[0] == "M":
            symbols[i] = i
    return symbols, letters


@dataclass(frozen=True)
class Stream:
    """The symbols of many texts in a row; every stretch without letters or marks is one blank."""

    symbols: np.ndarray
    text: np.ndarray  # the number of each symbol's text
    place: np.ndarray  # and its place in it
    letters: np.ndarray  # whether each text has a letter


def stream(texts: list[str]) -> Stream:
    symbols, letters = _symbols()
    codes = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), np.array([len(t) + 1 for t in texts], np.int64))
    own = symbols[codes]
    kept = own > 0
    kept[1:] |= kept[:-1].copy()
    own, at = own[kept], text[kept]
    sizes = np.bincount(at, minlength=len(texts))
    place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return Stream(np.where(own == 0, _BLANK, own).astype(np.uint64), at, place, np.bincount(text[letters[codes]], minlength=len(texts)) > 0)


def _before(s: Stream, k: int) -> np.ndarray:
    """The symbol k places before each; blanks stand before every text."""
    if not k:
        return s.symbols
    out = np.full(len(s.symbols), _BLANK, np.uint64)
    out[k:] = s.symbols[:-k]
    out[s.place < k] = _BLANK
    return out


def hashes(grams: np.ndarray) -> np.ndarray:
    """A hash for each row of symbols, oldest first."""
    out = np.zeros(len(grams), np.uint64)
    for k in range(grams.shape[1]):
        out += grams[:, -1 - k].astype(np.uint64) * _STEPS[k]
    return out


def _grams(s: Stream) -> np.ndarray:
    """The hash of the n-gram of the highest order that ends at each symbol."""
    return sum((_before(s, k) * _STEPS[k] for k in range(1, ORDER)), s.symbols * _STEPS[0])


def _at(s: Stream, at: np.ndarray) -> np.ndarray:
    """The n-grams that end at some symbols, a row of symbols each, oldest first."""
    back = np.arange(ORDER - 1, -1, -1)[None, :]
    found = s.symbols[np.maximum(at[:, None] - back, 0)].astype(np.uint32)
    return np.where(s.place[at][:, None] < back, np.uint32(_BLANK), found)


def _released(run):
    """``run`` over batches; workers outlive their tasks, so a task's free Arrow memory goes back at its end."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def count_grams(batches):
    """``lang, gram, n, n_fit`` of rows ``lang, held, text``, added up as far as ``COUNTED`` n-grams go, in batches of ``SENT``."""
    names: dict[str, int] = {}
    known: list[tuple[np.ndarray, ...]] = []

    def merged() -> tuple[np.ndarray, ...]:
        keys, langs, grams, n, fit = (np.concatenate(c) for c in zip(*known, strict=True))
        _, first, at = np.unique(keys, return_index=True, return_inverse=True)
        return keys[first], langs[first], grams[first], np.bincount(at, n).astype(np.int64), np.bincount(at, fit).astype(np.int64)

    def rows(keys, langs, grams, n, fit):
        every = list(names)
        for i in range(0, len(keys), SENT):
            part = slice(i, i + SENT)
            text = np.ascontiguousarray(grams[part]).view(f"<U{ORDER}").reshape(-1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([every[k] for k in langs[part].tolist()], pa.string()), pa.array(text, pa.string()), pa.array(n[part]), pa.array(fit[part])], ["lang", "gram", "n", "n_fit"])

    for batch in batches:
        for cut in slices(batch, rows=SLICE_ROWS, size=SLICE_BYTES):
            own = np.array([names.setdefault(x, len(names)) for x in cut.column("lang").to_pylist()], np.int64)
            s = stream([t or "" for t in cut.column("text").to_pylist()])
            if not len(s.symbols):
                continue
            langs = own[s.text]
            keys, first, at = np.unique(_grams(s) ^ (langs.astype(np.uint64) * _STEPS[1]), return_index=True, return_inverse=True)
            fit = ~np.array(cut.column("held").to_pylist(), bool)
            known.append((keys, langs[first], _at(s, first), np.bincount(at), np.bincount(at, fit[s.text])))
            if sum(len(k[0]) for k in known) > COUNTED:
                known = [merged()]
                if len(known[0][0]) > COUNTED * 3 // 4:
                    yield from rows(*known.pop())
    if known:
        yield from rows(*merged())


def gram_counts(docs: DataFrame, lang: Column, held: Column, text: Column) -> DataFrame:
    """``(lang, gram, n, n_fit)``: how often each n-gram occurs in a language, and how often in rows that aren't ``held``.

    Every task adds up its own before the shuffle. Rows without a language don't count.
    """
    labelled = docs.select(lang.cast("string").alias("lang"), F.coalesce(held, F.lit(False)).alias("held"), text.alias("text")).filter("lang is not null and text is not null")
    return labelled.mapInArrow(_released(count_grams), "lang string, gram string, n long, n_fit long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_fit").alias("n_fit"))


@dataclass(frozen=True)
class Model:
    """One language: for each order sorted hashes of n-grams with probabilities, and of contexts with back-off weights."""

    grams: list[np.ndarray]
    chances: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted ``keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def estimate(grams: np.ndarray, counts: np.ndarray, alphabet: int) -> Model:
    """Interpolated Kneser-Ney from the n-grams of the highest order (rows of symbols, oldest first) and their counts.

    One discount for each order, from the n-grams that occur once and twice; what the
    first order leaves goes to ``alphabet`` symbols equally.
    """
    levels = [(grams, counts.astype(float))]
    for n in range(ORDER - 1, 0, -1):
        wider = levels[-1][0]
        _, first, met = np.unique(hashes(wider[:, 1:]), return_index=True, return_counts=True)
        levels.append((wider[first][:, 1:], met.astype(float)))
    model = Model([], [], [], [])
    for n, (rows, count) in enumerate(reversed(levels), 1):
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, at = np.unique(hashes(rows[:, :-1]), return_inverse=True)
        total = np.bincount(at, count)
        weights = discount * np.bincount(at) / total
        lower = 1 / alphabet
        if n > 1:
            lower = model.chances[-1][_lookup(model.grams[-1], hashes(rows[:, 1:]))[0]]
        chance = np.maximum(count - discount, 0) / total[at] + weights[at] * lower
        order = np.argsort(keys := hashes(rows))
        model.grams.append(keys[order])
        model.chances.append(chance[order])
        model.contexts.append(contexts)
        model.weights.append(weights)
    return model


def log_chances(model: Model, grams: np.ndarray, alphabet: int) -> np.ndarray:
    """The log of each n-gram's last symbol's probability after the others; rows of symbols, oldest first."""
    p = np.full(len(grams), 1 / alphabet)
    for n in range(1, ORDER + 1):
        own = grams[:, ORDER - n :]
        at, met = _lookup(model.contexts[n - 1], hashes(own[:, :-1]))
        p = np.where(met, model.weights[n - 1][at] * p, p)
        at, seen = _lookup(model.grams[n - 1], hashes(own))
        p = np.where(seen, model.chances[n - 1][at], p)
    return np.log(p)


@dataclass(frozen=True)
class Calibration:
    """The temperature; each language's usual cross-entropy; the variance around it, ``level + share / n``; and how many standard deviations are too many."""

    temperature: float
    usual: np.ndarray
    level: float
    share: float
    most: float


@dataclass(frozen=True)
class Tables:
    """Models of all languages as tables: for each order ``lang, gram, chance`` and ``lang, context, weight``."""

    grams: list[DataFrame]
    contexts: list[DataFrame]


@dataclass(frozen=True)
class Models:
    langs: list[str]
    models: list[Model]
    alphabet: int
    calibration: Calibration | None = None
    tables: Tables | None = None  # instead of ``models``, where these would be too large


def decide(m: Models, n: int, letters: bool, e: np.ndarray) -> tuple[str, float, float | None, bool]:
    """``(language, score, cross-entropy, rejected)`` for a text of ``n`` symbols from its cross-entropies."""
    if not letters or not m.langs:
        return UNKNOWN, 0.0, None, True
    best, c = int(e.argmin()), m.calibration
    score = float(1 / np.exp((e[best] - e) * n / (c.temperature if c else 1.0)).sum())
    over = (e[best] - c.usual[best]) / np.sqrt(c.level + c.share / n) / c.most if c else 0.0
    return m.langs[best], score / max(1.0, over), float(e[best]), bool(over > 1)


class Scorer:
    """Cross-entropies of texts in all languages, remembering n-grams within a bound."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(models.langs)), np.float32)

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(n, letters, entropies)``: symbols of each text, whether it has a letter, and nats per symbol, a column for each language."""
        s, m = stream(texts), self.models
        n = np.bincount(s.text, minlength=len(texts))
        out = np.zeros((len(texts), len(m.langs)))
        if len(s.symbols) and m.langs:
            keys, first, at = np.unique(_grams(s), return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, keys)
            met = self.keys[np.minimum(place, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
            values = np.empty((len(keys), len(m.langs)), np.float32)
            values[met] = self.values[place[met]]
            if not met.all():
                fresh = _at(s, first[~met])
                values[~met] = np.stack([log_chances(x, fresh, m.alphabet) for x in m.models], axis=1)
                if len(self.keys) + len(fresh) > KEPT * 4 // max(4, len(m.langs)):
                    self.keys, self.values = self.keys[:0], self.values[:0]
                both, rows = np.concatenate([self.keys, keys[~met]]), np.concatenate([self.values, values[~met]])
                order = np.argsort(both)
                self.keys, self.values = both[order], rows[order]
            some = np.flatnonzero(n)
            out[some] = np.add.reduceat(values[at], (np.cumsum(n) - n)[some], axis=0, dtype=float) / -n[some, None]
        return n, s.letters, out

    def predict(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """``(language, score, cross-entropy, rejected)`` for each text."""
        return [decide(self.models, *x) for x in zip(*self.cross_entropies(texts), strict=True)]


def _losses(own: np.ndarray, n: np.ndarray, entropies: np.ndarray) -> np.ndarray:
    """Each text's loss (row) at each of the temperatures (column)."""
    gaps = -(entropies - entropies[np.arange(len(own)), own][:, None]) * n[:, None]
    # A hundredth goes to errors of any kind, so no temperature is infinitely wrong.
    return np.stack([-np.log(0.99 / np.exp(np.minimum(gaps / t, 700.0)).sum(axis=1) + 0.01 / entropies.shape[1]) for t in TEMPERATURES], axis=1)


def _loss(temperature: float, langs: int) -> Column:
    """The same of a row ``n, mine, e`` at one temperature."""
    raised = [F.exp(F.least((F.col("mine") - F.col("e")[i]) * F.col("n") / temperature, F.lit(700.0))) for i in range(langs)]
    return -F.log(0.99 / sum(raised[1:], raised[0]) + 0.01 / langs)


def calibrate(own: np.ndarray, n: np.ndarray, entropies: np.ndarray) -> Calibration | None:
    """From texts with known languages (``own`` is a column of ``entropies``) that the models haven't seen; none without texts."""
    if not len(own):
        return None
    temperature = TEMPERATURES[int(_losses(own, n, entropies).sum(axis=0).argmin())]
    mine = entropies[np.arange(len(own)), own]
    seen, weight = np.bincount(own, minlength=entropies.shape[1]), np.bincount(own, n, minlength=entropies.shape[1])
    mean = float((mine * n).sum() / n.sum())
    usual = np.where(seen > 0, np.bincount(own, mine * n, minlength=entropies.shape[1]) / np.maximum(weight, 1), mean)
    over = mine - usual[own]
    level, share = np.linalg.lstsq(np.stack([np.ones(len(n)), 1 / n], axis=1), over**2, rcond=None)[0]
    level, share = max(float(level), 1e-4), max(float(share), 1e-2)
    return Calibration(temperature, usual, level, share, max(1.0, float(np.quantile(over / np.sqrt(level + share / n), 1 - ALPHA))))


def calibrate_table(scored: DataFrame, langs: list[str]) -> Calibration | None:
    """``calibrate`` over a table ``lang, n, e`` of any size; rows of other languages don't count."""
    # Functions of Spark only: where ``scored`` comes from a Python stage, a second one would double the workers of each task.
    own = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    rows = scored.select(own.alias("own"), F.col("n").cast("double").alias("n"), "e").filter("own >= 0").withColumn("mine", F.col("e")[F.col("own").cast("int")])
    rows = materialise(rows.select("own", "n", "mine", *[_loss(t, len(langs)).alias(f"loss{k}") for k, t in enumerate(TEMPERATURES)]), "scored")
    losses = [F.sum(f"loss{k}").alias(f"loss{k}") for k in range(len(TEMPERATURES))]
    sums = rows.groupBy("own").agg(F.sum(F.col("mine") * F.col("n")).alias("nats"), F.sum("n").alias("n"), *losses).collect()  # a row for each language
    if not sums:
        return None
    temperature = TEMPERATURES[int(np.argmin([sum(r[f"loss{k}"] for r in sums) for k in range(len(TEMPERATURES))]))]
    usual = np.full(len(langs), sum(r["nats"] for r in sums) / sum(r["n"] for r in sums))
    for r in sums:
        usual[r["own"]] = r["nats"] / r["n"]
    part, over = 1 / F.col("n"), F.col("mine") - F.array(*[F.lit(float(x)) for x in usual])[F.col("own").cast("int")]
    m = rows.agg(F.count("*").alias("k"), F.sum(part).alias("p"), F.sum(part * part).alias("pp"), F.sum(over * over).alias("v"), F.sum(over * over * part).alias("vp")).first()
    level, share = np.linalg.lstsq(np.array([[m["k"], m["p"]], [m["p"], m["pp"]]]), np.array([m["v"], m["vp"]]), rcond=None)[0]
    level, share = max(float(level), 1e-4), max(float(share), 1e-2)
    place = (m["k"] - 1) * (1 - ALPHA)  # of the quantile among the sorted values, which lies ALPHA of the rows below the top
    low = int(place)
    top = rows.select((over / F.sqrt(level + share * part)).alias("z")).orderBy(F.desc("z")).offset(max(0, m["k"] - 2 - low)).limit(2).collect()
    high, least = top[0]["z"], top[-1]["z"]
    return Calibration(temperature, usual, level, share, max(1.0, float(least + (high - least) * (place - low))))


def _collect(counts: DataFrame, column: str) -> Models:
    """Models in memory, of all languages, from their n-gram counts; of more than ``MAX_GRAMS`` the rarest are lost, which ``fit`` never lets happen."""
    counts = counts.filter(F.col(column) > 0)
    sizes = counts.groupBy("lang", F.least(F.col(column), F.lit(1000)).alias("c")).count().collect()  # at most a thousand rows for each language
    langs = sorted({r["lang"] for r in sizes})
    if not langs:
        return Models([], [], 1)
    cuts, whole = [], sum(r["count"] for r in sizes) <= MAX_GRAMS
    for lang in langs:
        total, cut = 0, 1001
        for r in sorted((r for r in sizes if r["lang"] == lang), key=lambda r: -r["c"]):
            total += r["count"]
            if not whole and total > max(1, MAX_GRAMS // len(langs)):
                break
            cut = r["c"]
        cuts.append((lang, cut))
    least = counts.sparkSession.createDataFrame(cuts, "lang string, least long")
    rows = counts.join(F.broadcast(least), "lang").filter(F.col(column) >= F.col("least")).select("lang", "gram", F.col(column).alias("n")).toArrow()
    own = pc.index_in(rows.column("lang"), value_set=pa.array(langs, rows.column("lang").type)).to_numpy()
    # In parts, as every n-gram is a Python string on its way.
    parts = [np.frombuffer("".join(b.column("gram").to_pylist()).encode("utf-32-le"), np.uint32) for b in rows.to_batches(max_chunksize=SENT)]
    grams = np.concatenate([np.zeros(0, np.uint32), *parts]).reshape(-1, ORDER)
    counted = rows.column("n").to_numpy()
    alphabet = len(np.unique(grams[:, -1])) + 1 if len(grams) else 1
    known = [i for i in range(len(langs)) if (own == i).any()]
    return Models([langs[i] for i in known], [estimate(grams[own == i], counted[own == i], alphabet) for i in known], alphabet)


def estimate_tables(counts: DataFrame, column: str) -> Models:
    """``estimate`` for all languages by aggregations and joins: every n-gram counts, however many there are."""
    levels = [counts.filter(F.col(column) > 0).select("lang", "gram", F.col(column).cast("double").alias("c"))]
    for _ in range(ORDER - 1):
        levels.append(materialise(levels[-1].groupBy("lang", F.substring("gram", 2, ORDER).alias("gram")).agg(F.count("*").cast("double").alias("c")), "grams"))
    alphabet = levels[-1].select("gram").distinct().count() + 1
    tables = Tables([], [])
    for n, level in enumerate(reversed(levels), 1):
        seen = level.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice"))
        discount = F.when((F.col("once") > 0) & (F.col("twice") > 0), F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.5)
        rows = level.join(F.broadcast(seen.select("lang", discount.alias("d"))), "lang").withColumn("context", F.substring("gram", 1, n - 1))
        contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.first("d") * F.count("*") / F.sum("c")).alias("weight"))
        contexts = materialise(contexts, "contexts")
        rows = rows.join(contexts, ["lang", "context"])
        if n > 1:
            lower = tables.grams[-1].select("lang", F.col("gram").alias("suffix"), F.col("chance").alias("lower"))
            rows = rows.withColumn("suffix", F.substring("gram", 2, n)).join(lower, ["lang", "suffix"])
        chance = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * (F.col("lower") if n > 1 else F.lit(1 / alphabet))
        tables.grams.append(materialise(rows.select("lang", "gram", chance.alias("chance")), "chances"))
        tables.contexts.append(contexts.select("lang", "context", "weight"))
    langs = sorted(r["lang"] for r in levels[-1].select("lang").distinct().collect())
    return Models(langs, [], alphabet, tables=tables)


def _joined(rows: DataFrame, m: Models) -> DataFrame:
    """``row, n, letters, e`` of rows ``row, text``, by joins of their n-grams with the models' tables."""

    def run(batches):
        for batch in batches:
            for cut in slices(batch, rows=SLICE_ROWS, size=SLICE_BYTES):
                s = stream([t or "" for t in cut.column("text").to_pylist()])
                if len(s.symbols):
                    _, first, met = np.unique(_grams(s) ^ (s.text.astype(np.uint64) * _STEPS[1]), return_index=True, return_counts=True)
                    grams = np.ascontiguousarray(_at(s, first)).view(f"<U{ORDER}").reshape(-1).tolist()
                    yield pa.RecordBatch.from_arrays([cut.column("row").take(pa.array(s.text[first])), pa.array(grams, pa.string()), pa.array(met)], ["row", "gram", "k"])

    def lengths(batches):
        for batch in batches:
            for cut in slices(batch, rows=SLICE_ROWS, size=SLICE_BYTES):
                s = stream([t or "" for t in cut.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([cut.column("row"), pa.array(np.bincount(s.text, minlength=cut.num_rows)), pa.array(s.letters)], ["row", "n", "letters"])

    met = materialise(rows.select("row", "text").mapInArrow(_released(run), "row long, gram string, k long"), "met")
    wanted = materialise(met.groupBy("gram").agg(F.count("*").alias("n")), "wanted")
    chances = wanted.select("gram", F.explode(F.array(*[F.lit(x) for x in m.langs])).alias("lang"), F.lit(1 / m.alphabet).alias("p"))
    for n, (grams, contexts) in enumerate(zip(m.tables.grams, m.tables.contexts, strict=True), 1):
        start = ORDER - n + 1
        chances = chances.withColumn("context", F.substring("gram", start, n - 1)).join(contexts, ["lang", "context"], "left")
        chances = chances.withColumn("suffix", F.substring("gram", start, n)).join(grams.withColumnRenamed("gram", "suffix"), ["lang", "suffix"], "left")
        chances = chances.select("gram", "lang", F.coalesce("chance", F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
    each = [F.max(F.when(F.col("lang") == x, F.log("p").cast("float").cast("double"))).alias(f"p{i}") for i, x in enumerate(m.langs)]
    logs = materialise(chances.groupBy("gram").agg(*each).join(wanted, "gram"), "logs")
    sums = join_counted(met, logs, ["gram"], met.count()).groupBy("row").agg(*[F.sum(F.col(f"p{i}") * F.col("k")).alias(f"p{i}") for i in range(len(m.langs))])
    sized = rows.select("row", "text").mapInArrow(_released(lengths), "row long, n long, letters boolean").join(sums, "row", "left")
    return sized.select("row", "n", "letters", F.array(*[F.coalesce(F.col(f"p{i}") / -F.col("n"), F.lit(0.0)) for i in range(len(m.langs))]).alias("e"))


def entropies(rows: DataFrame, models: Models, *kept: str) -> DataFrame:
    """``n, letters, e`` and the ``kept`` columns of rows with ``text``: symbols, whether there is a letter, and nats per symbol in each language."""
    if models.tables is not None:
        named = materialise(rows.select(*kept, "text").withColumn("row", F.monotonically_increasing_id()), "texts")
        return _joined(named, models).join(named.select("row", *kept), "row").drop("row")
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for cut in slices(batch, rows=SLICE_ROWS, size=SLICE_BYTES):
                n, letters, e = scorer.cross_entropies([t or "" for t in cut.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(letters), pa.array(list(e), pa.list_(pa.float64())), *[cut.column(c) for c in kept]], ["n", "letters", "e", *kept])

    own = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, "text").mapInArrow(_released(run), f"n long, letters boolean, e array<double>{own}")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    """Calibrated models from all rows with a text and a language.

    Rows and n-grams are counted whole and all of them; every tenth row, by the checksum
    of the id, is left out of the models that the calibration uses, and calibrates.
    """
    held = F.pmod(F.floor(F.crc32(F.col(id_col).cast("string")) / 3), F.lit(10)) == 0
    counts = materialise(gram_counts(docs, F.col(lang_col), held, F.col(text_col)), "grams")
    build = _collect if counts.count() <= MAX_GRAMS else estimate_tables
    models, rest = build(counts, "n"), build(counts, "n_fit")
    calibration = None
    if rest.langs and rest.langs == models.langs:
        rows = docs.filter(held & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
        calibration = calibrate_table(entropies(rows, rest, "lang").filter("letters"), rest.langs)
    return replace(models, calibration=calibration)


def identify(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, cross_entropy, rejected)`` for every row, without a shuffle unless the models are tables.

    ``lang_pred`` is the language of the lowest cross-entropy, ``score`` its calibrated
    probability, which falls for texts whose language is ``rejected``. Null and empty
    texts and those without a letter, and all texts where no language is known, get
    ``und`` with score 0 and no cross-entropy. Ties go to the language that sorts first.
    Every row keeps its own result; an empty table gives no rows.
    """
    schema = "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def found(ids: pa.Array, decided) -> pa.RecordBatch:
        lang, score, entropy, rejected = zip(*decided, strict=True)
        return pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    if models.tables is not None:
        own = replace(models, tables=None)

        def choose(batches):
            for batch in batches:
                if batch.num_rows:
                    e = batch.column("e").flatten().to_numpy().reshape(batch.num_rows, -1)
                    yield found(batch.column("doc_id"), (decide(own, *x) for x in zip(batch.column("n").to_numpy(), batch.column("letters").to_pylist(), e, strict=True)))

        return entropies(rows, models, "doc_id").select("doc_id", "n", "letters", "e").mapInArrow(choose, schema)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for cut in slices(batch, rows=SLICE_ROWS, size=SLICE_BYTES):
                yield found(cut.column("doc_id"), scorer.predict([t or "" for t in cut.column("text").to_pylist()]))

    return rows.mapInArrow(_released(run), schema)


def op12_languages(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the documents outside the held-out third; rows with a null id are neither held out nor learnt from."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    models = fit(docs.filter(~held_out))
    return identify(docs, models).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
