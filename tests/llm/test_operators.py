"""Each operator against brute force on small tables, odd ones and empty ones among them."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import fingerprint as FP, licenses as L, mixing as MX, neighbours as NN, packing as PK, quality as Q, secrets as SC, simhash as SH, tokenfile as TF, toxicity as TX
from kindred.llm.registry import SQL, queries
from kindred.llm.tokens import WORD_BPE, Encoder, encoder, with_end

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(WORD_BPE))
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(x) -> int:
    return zlib.crc32(np.array(x, "<u4").tobytes())


# 1. fingerprints


def check_edits(found, rows):
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    texts = [t or "" for _, t, _ in order]
    following = dict(zip([d for d, _, _ in order], texts[1:] + texts[:1]))
    for r in found:
        mine = [t or "" for d, t, _ in rows if d == r["doc_id"]]
        assert r["fingerprint"] in {str(FP.State.of(t)) for t in mine}
        if len(mine) == 1 and sum(t == following[r["doc_id"]] for t in texts) >= 1:
            k = len(mine[0]) // 3
            changed = mine[0][: len(mine[0]) - k] + following[r["doc_id"]][:k]
            assert r["n_chars"] == len(mine[0])
            assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert r["edited_fingerprint"] == str(FP.State.of(changed))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(found) == len(rows)


def test_fingerprints(spark, docs):
    check_edits(queries()["op1_fingerprints"](spark, DATA).collect(), docs)


def test_fingerprints_odd(odd, odd_rows, empty):
    unambiguous = [r for r in odd_rows if r[0] not in (4, 5)]
    found = FP.edits(odd.filter("doc_id is null or doc_id not in (4, 5)")).collect()
    check_edits(found, unambiguous)
    assert FP.edits(odd).count() == len(odd_rows) and FP.edits(empty).count() == 0
    only = FP.edits(odd.filter("doc_id = 1")).first()
    assert only["near_next"] == 1.0
    assert FP.fingerprint(odd).count() == len(odd_rows)


def test_fingerprints_of_a_frequent_id(spark):
    """Half of the rows have no id, a fifth one id: each is followed by the next by hash of text, in several ranges."""
    rng = random.Random(3)
    rows = [(None if i % 2 else 7 if i % 5 == 0 else i, f"text {i} " + " ".join(rng.choice("abcdef") for _ in range(9))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    h = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], h[r[1]]), reverse=True)
    want = []
    for (d, t), (_, following) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        want.append((d, hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()))
    found = FP.edits(df)
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in found.collect()) == Counter(want)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 200


def fingerprint_truth(text):
    """Sums of SHAKE-128 lanes of the lines, and counts of three-word shingles, straight from the definition."""
    lines = text.split("\n") if text else []
    lanes = [sum(int.from_bytes(hashlib.shake_128(p.encode()).digest(256)[8 * i : 8 * i + 8], "little") for p in lines) % 2**64 for i in range(32)]
    shingles = Counter()
    for p in lines:
        w = p.split()
        shingles.update(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else shingles.update([tuple(w)] if w else [])
    return "".join(x.to_bytes(8, "little").hex() for x in lanes), shingles


def test_fingerprints_and_likeness_by_definition(docs):
    cosine = lambda a, b: sum(a[s] * b[s] for s in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    off = []
    for (_, s, _), (_, t, _) in itertools.pairwise(docs):
        (fa, a), (fb, b) = fingerprint_truth(s or ""), fingerprint_truth(FP.edited(s or "", t or ""))
        x, y = FP.State.of(s or ""), FP.State.of(FP.edited(s or "", t or ""))
        assert (str(x), str(y)) == (fa, fb)
        if fa != fb and sum(a.values()) > 50 and sum(b.values()) > 50:
            off.append(abs(x.likeness(y) - cosine(a, b)))
    assert len(off) > 20 and np.mean(off) < 0.06 and max(off) < 0.3


def test_multiset_hash():
    a = FP.State.of("x y z\nb\nb\nlast one")
    assert str(a) == str(FP.State.of("b\nlast one\nx y z\nb")) and str(a) != str(FP.State.of("x y z\nb\nlast one"))
    assert str(a.delete("b").insert("new")) == str(FP.State.of("new\nx y z\nb\nlast one"))
    assert str(FP.State.of("p\nq") + FP.State.of("r")) == str(FP.State.of("r\nq\np")) and str(a.delete("zz").insert("zz")) == str(a)
    rng = random.Random(2)
    text = [f"t{rng.randrange(5000)}" for _ in range(400)]
    half = text[:200] + [f"u{i}" for i in range(200)]
    assert abs(FP.State.of(" ".join(text)).likeness(FP.State.of(" ".join(half))) - 0.5) < 0.15


# 2. licenses


def license_truth(text):
    """The contract's phrases and labels, spelled out again."""
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    hits = [(i, label) for phrase, label in phrases.items() for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark, docs):
    truth = {d: license_truth(t) for d, t, _ in docs}
    for r in queries()["op2_licenses"](spark, DATA).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == truth[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_rules(odd, odd_rows, empty):
    assert len(L.rules()) > 200 and len({r.pattern.pattern for r in L.rules()}) == len(L.rules())
    line, _ = L.words_of("SPDX-License-Identifier: MIT, licensed under CC BY-NC-SA 4.0; under the MIT license under the MIT license, the Apache License, Version 2.0.")
    assert [f.label for f in L.scan(line)] == ["mit", "cc-by-nc-sa", "mit", "mit", "apache-2"]
    assert [x for _, x in L.places(line)] == ["cc-by-nc", "mit", "mit", "apache-2"]
    many, _ = L.words_of("released under the gnu general public license v2.1 " * 5000)
    assert len(L.scan(many)) >= 5000
    assert L.licenses(odd).count() == len(odd_rows) and L.licenses(empty).count() == 0


@pytest.mark.parametrize(
    ("notice", "label"),
    [
        ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2"),
        ("modify it under the terms of the GNU General Public License as published by", "gpl"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
        ("GNU General Public License version 3, 29 June 2007", "gpl-3"),
        ("licensed under GPLv3", "gpl-3"),
        ("licensed under LGPLv2.1", "lgpl-2.1"),
        ("released under MPLv2", "mpl-2"),
        ("GNU Affero General Public License", "agpl"),
        ("GNU Library General Public License", "lgpl"),
        ("the Eclipse Public License 2.0", "epl-2"),
        ("Apache License Version 2.0, January 2004", "apache-2"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("under the terms of the GNU General Public License version 3", "gpl-3"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3-or-later"),
        ("the GPL version 2 or any later version", "gpl-2-or-later"),
        ("available under LGPLv2.1 or later", "lgpl-2.1-or-later"),
        ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
        ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3"),
        ("All advertising materials mentioning features or use of this software must display the following acknowledgement", "bsd-4"),
        ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "apache-2"),
        ("// SPDX-License-Identifier: CC0-1.0", "cc0"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        (" ".join(("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
          "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")), "mit"),
    ],
)
def test_license_notices(notice, label):
    line, _ = L.words_of(f"Words before. {notice} Words after.")
    assert any(g in line for g in L.gate()) and [f.label for f in L.scan(line)] == [label]


def test_spdx_expressions():
    found = lambda t: [f.label for f in L.scan(L.words_of(t)[0])]
    assert found("SPDX-License-Identifier: MIT OR Apache-2.0") == ["mit", "apache-2"]
    assert found("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */") == ["gpl-2-or-later", "classpath-exception"]
    assert found("# SPDX-License-Identifier: (MIT AND BSD-3-Clause)") == ["mit", "bsd-3"]
    assert sorted(found("dual licensed under the MIT and GPL licenses")) == ["gpl", "mit"]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Dual licensed under the MIT or GPL Version 2 licenses.", ["gpl-2", "mit"]),
        ("Dual licensed under the MIT and GPL v2 licenses.", ["gpl-2", "mit"]),
        ("Dual licensed under the MIT or GPLv3 licenses.", ["gpl-3", "mit"]),
        ("This is not licensed under the MIT license.", []),
        ("It isn't released under the GNU General Public License version 2, nor covered by the MPL 2.0.", []),
        ("Not for sale. Licensed under the MIT license.", ["mit"]),
        ("It is not only licensed under the MIT license.", ["mit"]),
        ("The car has an MIT license plate.", []),
        ("MIT license", ["mit"]),
    ],
)
def test_license_names_versions_and_denials(text, labels):
    assert sorted(f.label for f in L.scan(L.words_of(f"Before. {text} After.")[0])) == labels


def test_gate_and_suppression_against_all_rules():
    """Every rule over the whole line, whatever its keywords; the sure ones first, longer before shorter, and what lies within one that is taken goes."""
    rng = random.Random(11)
    parts = ["released under the", "mit license", "gnu general public license", "version 2", "or later", "licensed under", "apache license version 2 0", "spdx license identifier", "gpl 2 0 or later", "with", "classpath exception 2 0", "cc by nc", "redistribution and use in source and binary forms",
             "with or without modification are permitted", "permission is hereby granted free of charge to any person obtaining a copy", "of this software and associated documentation files", "bsd", "subject to the terms of the mozilla public license v 2 0", "plain", "words"]
    for _ in range(150):
        line = f" {' '.join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))} "
        every = [(-r.sure, m.start() - m.end(), r.order, m.start(), m.end(), r.label) for r in L.rules() for m in r.pattern.finditer(line)]
        for m in L.SPDX.finditer(line):
            every += [(-L.SPDX_SURE, x.start() - x.end(), -1, x.start(), x.end(), L.signatures.SPDX[x["id"]]) for x in L._SPDX_PART.finditer(line, m.start(), m.end() + 1)]
        kept = []
        for _, _, order, a, b, label in sorted(every):
            if not any(x <= a and b <= y for _, x, y, _ in kept):
                kept.append((order, a, b, label))
        want = [(label, line.count(" ", 0, a) - 1, line.count(" ", 0, b)) for order, a, b, label in sorted(kept, key=lambda k: (k[1], k[0]))]
        assert [(f.label, f.start, f.end) for f in L.scan(line)] == want
        assert not every or any(g in line for g in L.gate())


# 3. token files


def test_token_file(spark, docs, ids):
    start = 0
    found = {r["doc_id"]: r for r in queries()["op3_token_file"](spark, DATA).collect()}
    for d, t, _ in docs:
        own = ids(t) + [2]
        assert (found[d]["start"], found[d]["n_tokens"], found[d]["ids_crc32"]) == (start, len(own), crc(own))
        start += len(own)


def test_token_file_odd(spark, odd, odd_rows, empty, ids, tmp_path):
    for segment_ids in (1 << 18, 50):
        at = f"file://{tmp_path}/tokens{segment_ids}"
        TF.write_tokens(odd, at, segment_ids=segment_ids)
        found = TF.read_tokens(spark, at).orderBy("start", "doc_id").collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((d, len(ids(t)) + 1, crc(ids(t) + [2])) for d, t, _ in odd_rows)
        keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
        some = sorted((r["doc_id"], len(r["ids"]), crc(r["ids"])) for r in TF.read_documents(spark, at, [4, 7, 102, 999]).collect())
        assert some == sorted((d, len(ids(t)) + 1, crc(ids(t) + [2])) for d, t, _ in odd_rows if d in (4, 7, 102))
        assert keys == sorted(keys) and [r["start"] for r in found] == [sum(x["n_tokens"] for x in found[:i]) for i in range(len(found))]
    TF.write_tokens(empty, f"file://{tmp_path}/none")
    assert TF.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 20, 31, 32])
def test_bit_packing(bits):
    x = np.random.default_rng(bits).integers(0, 2**bits, 10_000).astype("<u4")
    s = TF.Segment(TF.write_segment([7, None, 9], [x[:1], x[1:1], x[1:]], bits, block=333))
    assert (s.document(0) == x[:1]).all() and len(s.document(1)) == 0 and (s.document(2) == x[1:]).all()
    for lo, hi in ((0, 10_000), (332, 334), (5000, 5001), (9999, 10_000), (3, 3)):
        assert (s.range(lo, hi) == x[lo:hi]).all()
    with pytest.raises(ValueError):
        TF.write_segment([1], [np.array([1 << 5])], 5)


def test_word_cache_is_exact(ids):
    rng = random.Random(1)
    alphabet = "aBƲ7@~^`\\/ é'.,!<|>śİΣ1 \n\tѐЖ_-ǅſ\x1ć 日"
    texts = ["", "<|endoftext|>", "A<|endoftext|>b <|ENDOFTEXT|>", "don't CAN'T it's", "ΣΑΣ ΟΔΟΣ", "́abc", "a\x1cb", "x" * 3000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for kept in (5, 600_000):
        encoder = Encoder(kept=kept)
        got = [flat[a:b].tolist() for i in range(0, len(texts), 100) for flat, bounds in [encoder.encode(pa.array(texts).slice(i, 100))] for a, b in itertools.pairwise(bounds)]
        assert got == [ids(t) for t in texts]
    piece = Encoder(public_tokenizers.path("byte_bpe_50k.json"), by_word=False)
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    two = ["two  words\n", None, "one"]
    flat, bounds = with_end(*piece.encode(pa.array(two)), 5)
    assert [flat[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [whole.encode(t or "", add_special_tokens=False).ids + [5] for t in two]


# 4. packing


def plain_best_fit(items, capacity):
    bins: list[int] = []
    for x in sorted(items, reverse=True):
        open_ = [b for b in bins if capacity - b >= x]
        if open_:
            bins.remove(max(open_))
        bins.append((max(open_) if open_ else 0) + x)
    return sorted(bins)


def test_best_fit_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.choice([7, 16, 33, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        fill, seen, spans = Counter(), Counter(), defaultdict(list)
        for length, rank, n, first, offset in PK.best_fit(Counter(items), capacity):
            for k in range(n):
                seen[length, rank + k] += 1
                fill[first + k] += length
                spans[first + k].append((offset, length))
        assert sorted(fill.values()) == plain_best_fit(items, capacity)
        assert seen == Counter({(v, i): 1 for v, n in Counter(items).items() for i in range(n)})
        for s in spans.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length


def check_packing(found, rows, ids, capacity=4096):
    want = Counter()
    for d, t, _ in rows:
        own = ids(t) + [1]
        for k, lo in enumerate(range(0, len(own), capacity)):
            want[d, k, lo, len(own[lo : lo + capacity]), crc(own[lo : lo + capacity])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    groups = defaultdict(list)
    for r in found:
        groups[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in groups.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= capacity
    assert len(groups) == len(plain_best_fit([r["length"] for r in found], capacity))


def test_packing(spark, docs, ids):
    check_packing(queries()["op4_packing"](spark, DATA).collect(), docs, ids)


def test_packing_deals_pieces_without_ids(spark):
    """Rows without an id, and equal rows, are spread over tasks and still packed without a gap."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 4000, F.format_string("%05d", "id")).otherwise(F.lit("the same")).alias("text")).repartition(6)
        rows = PK.pack_documents(docs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 6000 and max(Counter(r["task"] for r in rows).values()) < 3000
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= PK.CAPACITY


def test_packing_odd(odd, odd_rows, empty, ids):
    check_packing(PK.pack_documents(odd).collect(), odd_rows, ids)
    check_packing(PK.pack_documents(odd, capacity=64).collect(), odd_rows, ids, 64)
    assert PK.pack_documents(empty).count() == 0


def test_encoder_forgets_before_it_grows_large():
    """Workers keep their encoder after packing, so its words count towards all later stages."""
    import corpus_pipeline

    own = encoder(kept=corpus_pipeline.KEPT_WORDS)
    for k in "abc":
        text = " ".join(f"{k}{i:x}" for i in range(110_000))
        flat, _ = own.encode(pa.array([text]))
        assert len(own.index) <= 220_000
    assert flat[:2000].tolist() == own.full.encode(text, add_special_tokens=False).ids[:2000]


# 5. quality


def test_quality_keeps_good_documents(spark):
    rows = queries()["op5_quality"](spark, "/root/testdata/sf0.01").select("doc_id", "keep").collect()
    label = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    kept = defaultdict(list)
    for r in rows:
        if r["doc_id"] in label:
            kept[label[r["doc_id"]]].append(r["keep"])
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.1


def test_quality_held_out(spark):
    """Trained on two thirds of the labels, the log-weight tells the other third apart."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    _, scored = Q.decide(docs, labels.filter("doc_id % 3 <> 0"))
    r = scored.join(labels.filter("doc_id % 3 = 0"), "doc_id").select("log_weight", "quality").toPandas()
    good, bad = r[r.quality == 1].log_weight.to_numpy(), r[r.quality == 0].log_weight.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95


def test_quality_model_and_sample(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1, None), (7, 1, 1), (100, 0, 0), (101, 1, 0), (None, 1, 1), (3, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    decision, scored = Q.decide(odd, labels)
    raw, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for d, t, _ in odd_rows:
        b = np.bincount(Q.buckets_of(t or ""), minlength=Q.BUCKETS)
        raw += b
        target += b * (d in (1, 7, 101))
    want = np.log((target + 30) / (raw * target.sum() / raw.sum() + 30))
    assert np.allclose(decision.model.ratio, want)
    for d, t, _ in odd_rows[:9]:  # without the document itself
        own = np.bincount(Q.buckets_of(t or ""), minlength=Q.BUCKETS)
        for y in (True, False):
            share = target.sum() / raw.sum()
            if (target >= own * y).all():
                ratio = np.log((target - own * y + 30) / ((raw - own) * share + 30))
                assert math.isclose(Q.left_out(raw, target, t or "", y), float(own @ ratio), abs_tol=1e-6)
    draws = sorted((r["draw"] for r in scored.collect()), reverse=True)
    assert len(draws) == len(odd_rows) and decision.cut == draws[decision.kept - 1]
    found = Q.classify(odd, labels).collect()
    assert sum(r["keep"] for r in found) == sum(d >= decision.cut for d in draws)
    kept = Q.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r["keep"] for r in found)
    assert Q.keep_good(odd, labels.limit(0)).count() == len(odd_rows)
    assert Q.classify(empty, labels).count() == 0


def test_gumbel_draws_follow_the_weights():
    """The largest of w + Gumbel noise is each row with the probability of its share of exp(w)."""
    w = np.log([1.0, 2.0, 4.0, 8.0])
    wins = Counter(int(np.argmax([x + Q.gumbel(i, f"t{trial}") for i, x in enumerate(w)])) for trial in range(6000))
    assert all(abs(wins[i] / 6000 - math.exp(x) / 15) < 0.02 for i, x in enumerate(w))


def test_kth_largest(spark):
    x = spark.createDataFrame([(float(v % 97),) for v in range(3000)], "draw double")
    order = sorted((float(v % 97) for v in range(3000)), reverse=True)
    for k in (1, 7, 1500, 3000):
        assert Q.kth_largest(x, k, few=3) == order[k - 1] == Q.kth_largest(x, k)


# 6. secrets


def secret_truth(text):
    """The contract's patterns, spelled out again."""
    name = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    spans = [(m.start(), 0, m.end()) for m in re.finditer(f"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(spans)]


def test_secrets(spark, docs):
    text = {d: t for d, t, _ in docs}
    for r in queries()["op6_secrets"](spark, DATA).collect():
        truth = secret_truth(text[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in truth).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x[0] == k for x in truth) for k in ("assign", "access", "hex")]


def test_secret_patterns_random():
    rng = random.Random(5)
    parts = ["token", "PASSWORD", "secret", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "ABC123", "0a1b2c3d" * 4, "f", "é", "key", "ſecret", "\n", "abcdefgh"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [(s.kind, s.start, s.end) for s in SC.strong(t)] == secret_truth(t)


def test_linking(spark, odd, odd_rows, empty):
    parts = 'client_id = "svc-reporting"\nvalue aZ9fKq27LmPq0RsTuVwXyZ12ab\nhttps://api.example.com/v1'
    kinds = lambda t: [s.kind for s in sorted(SC.linked(t, SC.strong(t)))]
    assert kinds(parts) == ["identifier", "key", "endpoint"]
    assert kinds(parts.replace("\n", "\n\n")) == []
    assert kinds(parts.replace("\n", " " * 500 + "\n")) == []
    assert kinds("user: bob is at https://example.com") == [] and kinds("aZ9fKq27LmPq0RsTuVwXyZ12ab") == []
    redacted = SC.redact(odd)
    assert redacted.columns == odd.columns and redacted.count() == len(odd_rows)
    df = spark.createDataFrame([(1, 'a token = "0123456789abcdef0123456789abcdef01234567" b', 9), (2, None, 9)], "doc_id long, text string, x int")
    assert [r["text"] for r in SC.redact(df).orderBy("doc_id").collect()] == ['a [assign]" b', None]
    assert SC.secrets(odd).count() == len(odd_rows) and SC.secrets(empty).count() == 0


def linked_truth(text, sure, window):
    """Every pair of complementary parts of a scope, in a plain loop."""
    weak = SC._weak(text, sure)
    cut = lambda s: len(re.findall(r"\n[^\S\n]*\n", text[: s.start + 1]))
    groups = defaultdict(list)
    for s in sure + weak:
        groups[cut(s)].append(s)
    out = set()
    for parts in groups.values():
        for a in parts:
            for b in parts:
                near = window is None or (a.start <= b.end + window and b.start <= a.end + window)
                if near and a.kind in ("identifier", "endpoint", "access") and b.kind in ("key", "assign", "hex"):
                    out |= {x for x in (a, b) if x.kind in SC.WEAK}
    return out


def test_linking_is_the_interval_join():
    rng = random.Random(4)
    parts = ["client_id: svc1", "https://a.example/x", "aZ9fKq27LmPq0RsTuVwXyZ12ab", "AKIA" + "B" * 16, "0a1b2c3d" * 4, "token = abcdefgh1", "plain words", "\n", "\n\n", " "]
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 24)))
        sure = SC.strong(text)
        for window in (None, 0, 12, 60):
            got = SC.linked(text, sure, window)
            assert len(got) == len(set(got)) and set(got) == linked_truth(text, sure, window)


def test_linking_of_one_long_text_is_not_quadratic():
    """One megabyte of value, and thousands of names and keys in one scope."""
    k = 8000
    text = "token = " + "x" * 1_000_000 + "".join(f"\nuser: name{i} aZ9fKq27LmPq0RsTuV{i:08d}" for i in range(k))
    began = time.process_time()
    assert len(SC.linked(text, SC.strong(text))) == 2 * k
    assert time.process_time() - began < 10


def test_linking_takes_long_keys_and_whole_scopes(spark):
    rng = random.Random(2)
    key = "aZ9" + "".join(rng.choice("abcXYZ0189+/") for _ in range(340)) + "=="
    parts = f"account_name: store7\n{key}\nhttps://api.example.com/v1"
    assert [s.kind for s in sorted(SC.linked(parts, []))] == ["identifier", "key", "endpoint"]
    far = f"client_id: svc-reporting\n{'plain words here ' * 100}\n{key}"
    df = spark.createDataFrame([(1, parts), (2, far), (3, far.replace("\n", "\n\n"))], "doc_id long, text string")
    got = {r["doc_id"]: [s["kind"] for s in r["more"]] for r in SC.secrets(df).collect()}
    assert got == {1: ["identifier", "key", "endpoint"], 2: ["identifier", "key"], 3: []}
    clean = {r["doc_id"]: r["text"] for r in SC.redact(df).collect()}
    assert clean[1] == "[identifier]\n[key]\n[endpoint]" and key not in clean[2] and key in clean[3]


# 7. near-duplicates


def simhash_truth(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def check_components(found, rows):
    fps = {hash_: simhash_truth(t) for _, t, _ in rows for hash_ in [t or ""]}
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[fps[t or ""]].append(d)
    nodes = list(groups)
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for x in nodes:
        least[find(x)] += [d for d in groups[x] if d is not None]
    want = Counter((d, f"{x:016x}", min(least[find(x)], default=None)) for x in nodes for d in groups[x])
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == want


def test_simhash(spark, docs):
    check_components(queries()["op7_simhash"](spark, DATA).collect(), docs)


def test_simhash_odd(odd, odd_rows, empty):
    found = SH.near_duplicates(odd).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    check_components(found.collect(), odd_rows)
    assert SH.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [64, 8192])
def test_anchors_lose_no_link(spark, tile):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**62, 4)]
    f = sorted({b ^ sum(1 << int(k) for k in set(rng.integers(0, 63, rng.integers(0, 9)))) for b in base for _ in range(300)})
    links = SH.near_links(spark.createDataFrame([(x,) for x in f], "fp long"), tile=tile).collect()
    assert all((r["src"] ^ r["dst"]).bit_count() <= 3 for r in links)

    def labels(edges):
        root = {x: x for x in f}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return [find(x) for x in f]

    assert labels((r["src"], r["dst"]) for r in links) == labels((a, b) for i, a in enumerate(f) for b in f[:i] if (a ^ b).bit_count() <= 3)


def test_keep_one(spark, odd, odd_rows, empty):
    kept = SH.keep_one(odd).collect()
    rows = SH.near_duplicates(odd).collect()
    assert len(kept) == len({r["component"] for r in rows}) and set(kept[0].asDict()) == set(odd.columns)
    assert SH.keep_one(empty).count() == 0


def jaccard(a, b, width=5):
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_at_a_similarity(spark, odd, empty):
    """Planted copies, single and in a large group, against all pairs; the pipeline's stage keeps one of each component."""
    import corpus_pipeline

    rng = random.Random(3)
    made = []
    for group in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(60 if group == 0 else 4):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            made.append(" ".join(copy))
    rng.shuffle(made)
    root = list(range(len(made)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(made)):
        for j in range(i):
            if jaccard(made[i], made[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, DATA).collect()}
    assert kept == {find(i) for i in range(len(made))}
    assert len(kept) < SH.keep_one(df).count()
    got = SH.keep_one(odd, width=5, similarity=0.8)
    assert got.columns == odd.columns and sum(not (r["text"] or "").strip() for r in got.collect()) == 1
    assert SH.keep_one(empty, similarity=0.8).count() == 0


def test_near_copies_that_no_band_of_minima_shares(spark, monkeypatch):
    """A pair at 0.8 whose 32 bands of 5 minima all differ, which bands missed; and whatever shingles count as common."""
    from kindred.llm import likeness as LK

    base = [f"b{k}" for k in range(44)]
    ends = ["w69157 w41606 w8271 w6317 w92571", "w64937 w11932 w58915 w89006 w49740", "w1 w2 w3 w4 w5 w6"]
    made = [" ".join([*base, e]) for e in ends]
    assert jaccard(made[0], made[1]) == 0.8 and jaccard(made[0], made[2]) < 0.8 and jaccard(made[1], made[2]) < 0.8
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for share in (8, 1):
        monkeypatch.setattr(LK, "SAMPLED", share)
        assert {r["doc_id"] for r in SH.keep_one(df, width=5, similarity=0.8).collect()} == {0, 2}

    rng = np.random.default_rng(4)
    known = np.unique(rng.integers(0, 300, 60)).astype(np.uint64)
    tried = 0
    for _ in range(4000):
        x = np.unique(rng.integers(0, 300, rng.integers(1, 60))).astype(np.uint64)
        y = np.union1d(rng.choice(x, max(1, len(x) - rng.integers(0, 6)), replace=False), rng.integers(0, 300, rng.integers(0, 6)).astype(np.uint64))
        shared = len(np.intersect1d(x, y))
        for least in (0.5, 0.8, 1.0):
            if shared / (len(x) + len(y) - shared) >= least:
                tried += 1
                for common in (known, known[:0]):
                    a, b = (LK.prefix(s, least, common, (common % 7).astype(np.int64)) for s in (x, y))
                    assert len(np.intersect1d(a, b))
    assert tried > 1000


# 8. neighbours


def cosine_truth(rows, queries_, k):
    out = {}
    for q, v in queries_:
        v = np.array(v, float)
        c = sorted((-float((np.array(u, float) * v).sum() / (math.sqrt((np.array(u, float) ** 2).sum()) * math.sqrt((v**2).sum()))), i) for i, u in rows if i != q)
        out[q] = [i for _, i in c[:k]]
    return out


def test_neighbours_recall(spark):
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY 1").fetchall()
    found = defaultdict(list)
    for r in queries()["op8_neighbours"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    truth = cosine_truth(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert set(found) == set(truth) and all(len(v) == 5 for v in found.values())
    assert np.mean([len(set(found[q]) & set(truth[q])) / 5 for q in truth]) >= 0.93


def test_neighbours_odd(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(30)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(40)] + [(50, [1.0, 2.0, 3.0, 4.0])]
    bad = [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 1.0, 1.0]), (204, [math.inf, 1.0, 1.0, 1.0]), (205, [math.nan] * 4), (250, [1.0, 2.0]), (251, [1.0, 1.0]), (252, [2.0, 0.5]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1.0, 3) for i, v in rows + bad], "vec_id long, embedding array<double>, rank string, score double, query_id int")
    found = defaultdict(list)
    for r in NN.search(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    want = cosine_truth(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert found.pop(250) == [251, 252]  # each length on its own
    assert dict(found) == want
    assert found[50] == [100, 101, 102, 103, 104] and found[100][:2] == [50, 101]
    few = NN.search(df.filter("vec_id < 3"), F.col("vec_id") == 0, 5)
    assert few.count() == 2 and NN.search(df.limit(0), F.col("vec_id") == 0, 5).count() == 0


# 9. toxicity


def test_toxicity_held_out(spark):
    label = dict(duckdb.sql("SELECT doc_id, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    found = queries()["op9_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = [(r["predicted"], label[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in label]
    assert np.mean([p == y for p, y in held]) > 0.95 and np.mean([p for p, y in held if y]) > 0.7 and np.mean([p for p, y in held if not y]) < 0.02


def segments_truth(ws):
    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += ws[j]
                if total > 1e-12 and (top is None or total > top[2] + 1e-9 or (abs(total - top[2]) <= 1e-9 and j - i < top[1] - top[0])):
                    top = (i, j, total)
        return [] if top is None else best(lo, top[0]) + [top] + best(top[1] + 1, hi)

    return best(0, len(ws))


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(1500):
        ws = [TX.OTHER if rng.random() < 0.7 else round(rng.uniform(-1, 2), 3) for _ in range(rng.randint(0, 25))]
        got, want = TX.maximal_segments([(i, w) for i, w in enumerate(ws) if w != TX.OTHER]), segments_truth(ws)
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, want))


def law_truth(rows, labels):
    """Lexicon, lambda and K of ``(id, text)`` rows, from their definitions."""
    seen = {y: Counter(e for i, t in rows if labels[i] == y for e in {e for w in set(t.split()) for e in TX.entries(w)}) for y in (0, 1)}
    n = {y: sum(seen[y].values()) for y in (0, 1)}
    lexicon, clean = {}, {}
    for e in seen[0] | seen[1]:
        a = TX.PRIOR_SHARE * (seen[0][e] + seen[1][e])
        prior = TX.PRIOR_SHARE * (n[0] + n[1])
        odds = [math.log((seen[y][e] + a) / (n[y] + prior - seen[y][e] - a)) for y in (0, 1)]
        if abs(odds[1] - odds[0]) / math.sqrt(1 / (seen[1][e] + a) + 1 / (seen[0][e] + a)) > TX.LEAST_Z:
            lexicon[e], clean[e] = odds[1] - odds[0], seen[0][e] + 0.5
    words = {e: v for e, v in lexicon.items() if not e.startswith("^")}
    rest = max(n[0] - sum(clean[e] for e in words), 1.0)
    total = rest + sum(clean[e] for e in words)
    moment = lambda rate: sum(clean[e] * math.exp(rate * v) for e, v in words.items()) / total + rest * math.exp(rate * TX.OTHER) / total
    return lexicon, moment


def best_truth(lexicon, text):
    """The totals of all maximal segments of a text."""
    weights = []
    for w in text.split():
        known = [lexicon[e] for e in (w, *("^" + w[:k] for k in TX.PREFIXES if len(w) > k)) if e in lexicon]
        weights.append(max(known) if known else TX.OTHER)
    return [s for _, _, s in segments_truth(weights)]


def statistic_truth(n, totals, rate, k):
    """Minus the log of the smallest chance of any r best normalised totals, by the formula with its factorials."""
    x = sorted((rate * s - math.log(k * max(n, 1)) for s in totals), reverse=True)
    first = rate * max(totals, default=0.0) - math.log(k * max(n, 1))
    chances = [max(-math.expm1(-math.exp(-first)), 1e-300)]
    for r in range(1, len(x) + 1):
        t = sum(x[:r])
        if x[r - 1] > 0 and t > r * r:
            chances.append(math.exp(-t) * t ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)) * (r * (r + 1) / 2))
    return -math.log(min(chances))


def test_statistic_against_the_law_of_the_r_best():
    rng = random.Random(8)
    for _ in range(500):
        rate, k, n = rng.uniform(0.3, 2), rng.uniform(0.01, 1), rng.randrange(0, 400)
        totals = [rng.uniform(0.1, 12) for _ in range(rng.randrange(0, 9))]
        got = TX.Scorer(TX.Model({}, rate, k, 0.0, 1.0)).statistic(n, [(i, i, s) for i, s in enumerate(totals)])
        assert math.isclose(got, statistic_truth(n, totals, rate, k), rel_tol=1e-9, abs_tol=1e-9)


def test_log_odds_root_and_calibration(spark):
    """The lexicon, the law's constants and the curve of two folds, each against its definition."""
    rng = random.Random(12)
    bad, common = [f"bad{c}" for c in "abcde"], [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    kind = [f"kind{c}" for c in "abc"]  # stand out in clean documents
    rows = [(i, " ".join([rng.choice(common) for _ in range(60)] + [rng.choice(bad if i % 4 == 0 else kind) for _ in range(6)])) for i in range(400)]
    labels = {i: int(i % 4 == 0) for i, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = TX.fit(docs, labels)
    lexicon, moment = law_truth(rows, labels)
    assert set(model.lexicon) == set(lexicon) and all(math.isclose(model.lexicon[e], lexicon[e], rel_tol=1e-9) for e in lexicon)
    assert set(bad) | set(kind) <= set(lexicon) and all(lexicon[e] < 0 for e in kind)
    assert math.isclose(moment(model.rate), 1.0, rel_tol=1e-6)
    best = {i: max(best_truth(lexicon, t), default=0.0) for i, t in rows}
    assert math.isclose(model.k, 300 / sum(66 * math.exp(-model.rate * best[i]) for i in best if not labels[i]), rel_tol=1e-9)
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(TX.FOLDS)), F.lit(TX.FOLDS)).alias("f")).collect()}
    x, y = [], []
    for f in range(TX.FOLDS):
        own, moment = law_truth([r for r in rows if fold[r[0]] != f], labels)
        lo, hi = 1e-6, 50.0
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if moment(mid) < 1 else (lo, mid)
        others = [(i, max(best_truth(own, t), default=0.0)) for i, t in rows if fold[i] != f and not labels[i]]
        k = len(others) / sum(66 * math.exp(-lo * s) for _, s in others)
        for i, t in rows:
            if fold[i] == f:
                x.append(statistic_truth(66, best_truth(own, t), lo, k))
                y.append(labels[i])
    x, y = np.array(x), np.array(y, float)
    loss = lambda b0, b1: float(np.sum(np.logaddexp(0, b0 + b1 * x) - y * (b0 + b1 * x)) + b1 * b1 / 2)
    least = loss(model.intercept, model.slope)
    assert all(loss(model.intercept + d0, model.slope + d1) >= least - 1e-6 for d0 in (-0.1, 0, 0.1) for d1 in (-0.05, 0, 0.05))
    scorer = TX.Scorer(model)
    for i, _ in rows[:8]:
        expected = model.k * 66 * math.exp(-model.rate * best[i])
        assert math.isclose(scorer.p_value(66, best[i]), -math.expm1(-expected), rel_tol=1e-6) and (scorer.p_value(66, best[i]) <= TX.ALPHA) == bool(labels[i])


def test_toxicity_odd(spark, odd, odd_rows, empty):
    for labels in ({}, {1: 0}, {1: 1, 100: 0, 101: 0, 7: 1}):
        model = TX.fit(odd, labels)
        assert TX.score(odd, model).filter("score between 0 and 1").count() == len(odd_rows)
    assert TX.score(empty, model).count() == 0 and TX.fit(empty, {1: 1, 2: 0}).slope == 0.0
    table = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert TX.labelled_sample(table, "doc_id", "toxic") == {1: 1}


# 10. mixing


def check_mix(found, rows):
    size = {}
    for d, t, s in rows:
        size.setdefault((d, s), []).append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    total = defaultdict(int)
    for (_, s), n in size.items():
        total[s] += sum(n)
    order = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, free = {}, sum(total.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] > 3 * total[s]}
        if not capped:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * total[s] for s in capped}
        left -= sum(3 * total[s] for s in capped)
        free -= capped
    return total, target


def test_mixing(spark, docs):
    total, target = check_mix([], docs)
    source = {d: s for d, _, s in docs}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in queries()["op10_mixing"](spark, DATA).collect():
        s = source[r["doc_id"]]
        assert r["source_size"] == total[s] and math.isclose(r["target"], target[s], rel_tol=1e-9) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], largest[s])


def test_mixing_odd(odd, odd_rows, empty):
    total, target = check_mix([], odd_rows)
    found = MX.mix_documents(odd).collect()
    assert len(found) == len(odd_rows)
    assert {r["source_size"] for r in found} == set(total.values())
    assert {round(r["target"], 6) for r in found} == {round(t, 6) for t in target.values()}
    assert all(0 <= r["copies"] <= 3 for r in found) and sorted(map(str, found)) == sorted(map(str, MX.mix_documents(odd).collect()))
    rows = MX.mixed(odd)
    assert rows.columns == odd.columns and rows.count() == sum(r["copies"] for r in found)
    assert MX.mix_documents(empty).count() == 0 and MX.mixed(empty).count() == 0


def test_mixing_of_repeated_ids_agrees(spark):
    """Rows with one id in several deals: the same payloads are taken as often."""
    rng = random.Random(6)
    rows = [(7, " ".join(["w"] * rng.choice([3, 5])), "ab"[i % 5 == 0], f"p{i}", {"k": i}) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, payload string, m map<string,int>")
    runs = [Counter(r["payload"] for r in MX.mixed(df.repartition(n, "payload")).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and sum(runs[0].values()) > 0


def test_targets_of_many_sources(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.choice([1, 1, 2, 40, 900])), f"s{i % 60}") for i in range(400)]
    total, target = check_mix([], rows)
    sizes = spark.createDataFrame([("0" + s, n, 1) for s, n in total.items()], "key string, size long, n long")
    got = {r["key"][1:]: r["target"] for r in MX.targets(sizes).collect()}
    assert set(got) == set(target) and all(math.isclose(got[s], target[s], rel_tol=1e-9) for s in target)


def test_tilt_solves_the_dual(spark, docs):
    """The rates meet the targets, and log-odds are linear in the size within a source."""
    found = queries()["op10_mixing"](spark, DATA).toPandas().merge(__import__("pandas").DataFrame(docs, columns=["doc_id", "text", "source"]), on="doc_id")
    for _, g in found.groupby("source"):
        if g.target.iloc[0] < 2.99 * g.source_size.iloc[0]:
            assert math.isclose((g.rate * g["size"]).sum(), g.target.iloc[0], rel_tol=1e-6)
            odds = np.log(g.rate / (3 - g.rate) * 2)
            ok = np.isfinite(odds) & (g.rate > 1e-6) & (g.rate < 3 - 1e-6) & (g["size"] > 0)
            slope = odds[ok] / g["size"][ok]
            assert np.allclose(slope, slope.iloc[0], rtol=1e-3, atol=1e-9)


# All of them


def test_pipeline(spark, ids):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
        if name in ("quality", "near_duplicates"):
            assert docs.join(before, columns, "left_anti").count() == 0 and docs.count() < before.count()
        if name == "secrets":
            assert all(not SC.strong(r["text"]) and r["n_chars"] == len(r["text"]) for r in docs.collect())
    rows = [(r["doc_id"], r["text"], None) for r in docs.collect()]
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect(), rows, ids)
    assert corpus_pipeline.run(spark, DATA).count() == corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count()


def test_pipeline_of_odd_rows(spark, odd, empty):
    """Every stage after the other on nulls, repeated rows and clashing names, and on no rows."""
    import corpus_pipeline

    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, DATA)
            assert found.columns == odd.columns
            docs = spark.createDataFrame(found.collect(), odd.schema)
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count()
        assert pieces >= docs.count() and (pieces > 0) == (docs.count() > 0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    found = queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in found.collect()) == Counter(want.fetchall())
