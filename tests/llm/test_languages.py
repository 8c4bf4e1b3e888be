"""Character models against a plain version of the formulas, and held-out accuracy."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.llm import languages as L

DATA = "/root/testdata/sf0.01"


def normal(text: str) -> str:
    """Letters in lower case, everything between as one blank, a blank at the end."""
    out = ""
    for c in (text or "") + "\0":
        low = c.lower() if c.isalpha() else " "
        if low != " " or (out and out[-1] != " "):
            out += low
    return out


class Plain:
    """Interpolated Kneser-Ney by dictionaries of strings."""

    def __init__(self, texts: list[str], alphabet: int | None = None) -> None:
        n = L.ORDER
        grams = Counter(("    " + t)[i : i + n] for t in map(normal, texts) for i in range(len(t)))
        self.counts = {n: grams}
        for k in range(n - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.alphabet = alphabet or len({g[-1] for g in grams}) + 1
        self.discount, self.total, self.kinds = {}, defaultdict(float), Counter()
        for k, c in self.counts.items():
            once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.discount[k] = once / (once + 2 * twice) if once and twice else 0.5
            for g, v in c.items():
                self.total[k, g[:-1]] += v
                self.kinds[k, g[:-1]] += 1

    def chance(self, gram: str) -> float:
        k = len(gram)
        if not k:
            return 1 / self.alphabet
        lower, key = self.chance(gram[1:]), (k, gram[:-1])
        if key not in self.total:
            return lower
        d = self.discount[k]
        return max(self.counts[k][gram] - d, 0) / self.total[key] + d * self.kinds[key] / self.total[key] * lower

    def entropy(self, text: str) -> float:
        t = normal(text)
        return -sum(math.log(self.chance(("    " + t)[i : i + L.ORDER])) for i in range(len(t))) / len(t)


def made(rng: random.Random, letters: str, n: int) -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    letters = {"xx": "abcdefgh", "yy": "efghijkl", "zz": "дежзиклм"}
    return [(i, made(rng, letters[lang], rng.randrange(1, 40)), lang) for i in range(400) for lang in [rng.choice(list(letters))]]


def test_models_equal_the_plain_formulas(spark, rows):
    models = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert models.langs == ["xx", "yy", "zz"]
    rng = random.Random(7)
    texts = [made(rng, "abcdefghijklдеж", 12), "Ab, CD!", "q", "éA" * 50, rows[0][1]]
    n, letters, got = L.Scorer(models).cross_entropies(texts)
    plain = [Plain([t for _, t, x in rows if x == lang], models.alphabet) for lang in models.langs]
    assert models.alphabet == len(set("".join(normal(t) for _, t, _ in rows))) + 1
    assert np.allclose(got, [[p.entropy(t) for p in plain] for t in texts], rtol=1e-5)
    assert n.tolist() == [len(normal(t)) for t in texts] and letters.all()


def test_chances_sum_to_one(rows):
    texts = [t for _, t, lang in rows if lang == "xx"]
    plain = Plain(texts)
    symbols = sorted({c for t in texts for c in normal(t)})
    s = L.stream(texts)
    grams = L._at(s, np.arange(len(s.symbols)))
    keys, first, counts = np.unique(L.hashes(grams), return_index=True, return_counts=True)
    model = L.estimate(grams[first], counts, plain.alphabet)
    for context in ("    ", "ab c", "abcd", "zzzz", "  ab"):
        every = np.array([[ord(c) for c in context + x] for x in symbols + ["?"]], np.uint32)
        assert math.isclose(np.exp(L.log_chances(model, every, plain.alphabet)).sum(), 1, rel_tol=1e-9)


def test_remembered_chances_do_not_change_results(rows, monkeypatch):
    models = L.Models(["xx"], [L.estimate(np.array([[32, 32, 97, 98, 99]], np.uint32), np.array([3]), 4)], 4)
    texts = [t for _, t, _ in rows[:60]]
    whole = L.Scorer(models).cross_entropies(texts)[2]
    monkeypatch.setattr(L, "KEPT", 50)
    scorer = L.Scorer(models)
    assert np.array_equal(whole, np.concatenate([scorer.cross_entropies(texts[i : i + 7])[2] for i in range(0, 60, 7)]))


def test_calibration_rejects_its_share_and_other_texts():
    rng = np.random.default_rng(1)
    n = rng.integers(20, 2000, 4000).astype(float)
    own = rng.integers(0, 2, 4000)
    e = np.full((4000, 2), 4.0)
    e[np.arange(4000), own] = 2 + own * 0.3 + rng.normal(0, 1, 4000) * np.sqrt(0.01 + 1 / n)
    c = L.calibrate(own, n, e)
    over = (e[np.arange(4000), own] - c.usual[own]) / np.sqrt(c.level + c.share / n) / c.most
    assert abs((over > 1).mean() - L.ALPHA) <= L.ALPHA
    assert (4.0 - c.usual[0]) / math.sqrt(c.level + c.share / 1000) > c.most
    assert L.calibrate(own[:0], n[:0], e[:0]) is None


def test_grams_over_the_bound_lose_the_rarest(spark, rows, monkeypatch):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = L.gram_counts(table, F.col("lang"), F.lit(False), F.col("text"))
    whole = L._collect(counts, "n")
    monkeypatch.setattr(L, "MAX_GRAMS", 900)
    less = L._collect(counts, "n")
    assert less.langs == whole.langs
    assert all(len(m.grams[-1]) <= 300 < len(w.grams[-1]) for m, w in zip(less.models, whole.models, strict=True))


def test_odd_rows(spark, odd, odd_rows, empty, rows):
    models = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"], r["cross_entropy"]) for r in L.identify(odd, models).collect()), key=str)
    assert sorted(str(d) for d, *_ in got) == sorted(str(d) for d, *_ in odd_rows)
    silent = {d for d, t, _ in odd_rows if not any(c.isalpha() for c in t or "")}
    assert {d for d, lang, *_ in got if lang == "und"} == silent
    assert all(0 <= s <= 1 and (s == 0) == (lang == "und") == (e is None) for _, lang, s, e in got)
    assert L.identify(empty, models).count() == 0
    assert not L.fit(empty).langs and not L.fit(odd.withColumn("lang", F.lit(None).cast("string"))).langs
    assert {r["lang_pred"] for r in L.identify(odd, L.fit(empty)).collect()} == {"und"}
    assert set(L.fit(odd).langs) == {"en"}


def test_held_out_accuracy(spark):
    found = L.op12_languages(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == 1000
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.99 and held.rejected.mean() < 0.03
    assert held.score.between(0, 1).all()


def test_the_held_out_third_is_not_learnt_from(spark, tmp_path, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    table.write.parquet(f"{tmp_path}/a/documents.parquet")
    table.withColumn("lang", F.when(held, F.lit("qq")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/b/documents.parquet")
    a, b = (sorted(map(tuple, L.op12_languages(spark, f"{tmp_path}/{k}").collect())) for k in "ab")
    assert a == b


def test_more_grams_than_fit_in_memory_lose_none(spark, rows, odd, odd_rows, monkeypatch):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    held = spark.createDataFrame([(i, t, None) for i, (t) in enumerate(["abc \u0436", "", None, "12", "q q", "Hello, wörld"], 1000)], "doc_id long, text string, lang string")
    texts = table.unionByName(held).unionByName(odd.select(F.col("doc_id").cast("long"), "text", "lang"))
    key = lambda r: (str(r["doc_id"]), r["lang_pred"], r["rejected"], round(r["score"], 5), round(r["cross_entropy"] or 0, 5))
    whole = L.fit(table)
    want = sorted(map(key, L.identify(texts, whole).collect()))
    monkeypatch.setattr(L, "MAX_GRAMS", 900)
    models = L.fit(table)
    assert not models.models and models.tables and models.langs == whole.langs and models.alphabet == whole.alphabet
    assert [g.count() for g in models.tables.grams] == [sum(len(m.grams[k]) for m in whole.models) for k in range(L.ORDER)]
    assert np.isclose(models.calibration.most, whole.calibration.most, rtol=1e-5)
    assert sorted(map(key, L.identify(texts, models).collect())) == want


def test_a_language_with_a_larger_part_keeps_its_grams(spark, rows, monkeypatch):
    table = spark.createDataFrame([r for r in rows if r[2] != "xx" or r[0] % 20 == 0], "doc_id long, text string, lang string")
    counts = L.gram_counts(table, F.col("lang"), F.lit(False), F.col("text"))
    monkeypatch.setattr(L, "MAX_GRAMS", counts.count())
    assert sum(len(m.grams[-1]) for m in L._collect(counts, "n").models) == counts.count()


def test_every_held_row_calibrates(spark):
    rng = np.random.default_rng(2)
    n, own = rng.integers(20, 2000, 7000), rng.integers(0, 3, 7000)
    e = 2 + rng.random((7000, 3)) + np.where(np.arange(3) == own[:, None], -0.5, 0)
    scored = spark.createDataFrame([("xyz"[i], int(k), x.tolist()) for i, k, x in zip(own, n, e)] + [("?", 5, [1.0, 1.0, 1.0])], "lang string, n long, e array<double>")
    want, got = L.calibrate(own, n.astype(float), e), L.calibrate_table(scored, ["x", "y", "z"])
    assert np.allclose(got.usual, want.usual) and got.temperature == want.temperature
    assert np.allclose([got.level, got.share, got.most], [want.level, want.share, want.most], rtol=1e-6)
    assert L.calibrate_table(scored.limit(0), ["x"]) is None
    one = L.calibrate_table(scored.filter("lang = 'x'").limit(1), ["x", "y", "z"])
    assert one.most >= 1


def test_no_task_needs_two_python_workers(spark, rows, monkeypatch):
    made, write = [], L.materialise
    monkeypatch.setattr(L, "materialise", lambda df, *tag: made.append(df) or write(df, *tag))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = L.fit(table)
    assert models.calibration
    assert [df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") for df in [*made, L.identify(table, models)]] == [1, 1, 1]


def test_counting_holds_and_hands_over_few_grams_at_once():
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 2500))) for _ in range(450)]
    batch = pa.RecordBatch.from_arrays([pa.array(["xx", "yy"] * 225), pa.array([False, False, True] * 150), pa.array(texts)], ["lang", "held", "text"])
    L.stream(["a"])
    tracemalloc.start()
    most, counts = 0, [0, 0]
    for part in L.count_grams(iter([batch])):
        most, counts = max(most, part.num_rows), [counts[0] + sum(part.column("n").to_pylist()), counts[1] + sum(part.column("n_fit").to_pylist())]
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert counts == [450 * 2501, 300 * 2501]
    assert most <= 50_000 and peak < 160


def test_counts_handed_over_in_parts_stay_whole(spark, rows, monkeypatch):
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    count = lambda: sorted(map(tuple, L.gram_counts(table, F.col("lang"), F.col("doc_id") % 3 == 0, F.col("text")).collect()))
    plain = {lang: Counter(("    " + t)[i : i + L.ORDER] for _, text, x in rows if x == lang for t in [normal(text)] for i in range(len(t))) for lang in ("xx", "yy", "zz")}
    fit = {lang: Counter(("    " + t)[i : i + L.ORDER] for d, text, x in rows if x == lang and d % 3 for t in [normal(text)] for i in range(len(t))) for lang in plain}
    want = sorted((lang, g, n, fit[lang][g]) for lang, c in plain.items() for g, n in c.items())
    assert count() == want
    batch = pa.RecordBatch.from_pydict({"lang": [x for *_, x in rows], "held": [d % 3 == 0 for d, *_ in rows], "text": [t for _, t, _ in rows]})
    monkeypatch.setattr(L, "COUNTED", 700)
    monkeypatch.setattr(L, "SENT", 60)
    monkeypatch.setattr(L, "SLICE_ROWS", 7)
    sums: dict = defaultdict(lambda: [0, 0])
    parts = list(L.count_grams(iter([batch])))
    for r in (r for p in parts for r in p.to_pylist()):
        sums[r["lang"], r["gram"]][0] += r["n"]
        sums[r["lang"], r["gram"]][1] += r["n_fit"]
    assert max(p.num_rows for p in parts) == 60 and sum(p.num_rows for p in parts) > len(want)
    assert sorted((*k, *v) for k, v in sums.items()) == want
