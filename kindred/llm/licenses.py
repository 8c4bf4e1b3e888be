"""License scans by ordered signature rules.

Texts are lowered and reduced to their words, one space apart, so every rule is a
regular expression over whole words. A rule runs only where its keyword occurs. What
the rules find is taken in order of priority, longer first, and a finding that lies
within the interval of one already taken is suppressed. A declaration that the words
before it deny suppresses like any other, but isn't reported.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm import signatures
from kindred.llm.common import map_rows, table

#: Fixed values of the contract: phrases whose places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Licenses, by label: the keyword that must occur, and how the name is written in words.
NAMES = {
    "mit": ("mit", "(?:mit|expat)"),
    "mit-0": ("mit", "mit (?:0|no attribution)"),
    "x11": ("x11", "x11"),
    "isc": ("isc", "isc"),
    "bsd-2": ("bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    "bsd-3": ("bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)"),
    "bsd-4": ("bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"),
    "bsd": ("bsd", "bsd(?: style)?"),
    "0bsd": ("bsd", "(?:0bsd|zero clause bsd|bsd zero clause)"),
    "apache-1": ("apache", "apache(?: software)?(?: license)?(?: version)? 1(?: [01])?"),
    "apache-2": ("apache", "(?:apache(?: software)?(?: license)?(?: version)? 2(?: 0)?|apache2)"),
    "gpl-1": ("gpl|general", "(?:gnu )?(?:gpl|general public license)(?: version)? v?1(?: 0)?"),
    "gpl-2": ("gpl|general", "(?:gnu )?(?:gpl|general public license)(?: version)? v?2(?: 0)?"),
    "gpl-3": ("gpl|general", "(?:gnu )?(?:gpl|general public license)(?: version)? v?3(?: 0)?"),
    "gpl": ("gpl|general", "(?:gnu )?(?:gpl|general public license)"),
    "lgpl-2": ("lgpl|lesser|library", "(?:gnu )?(?:lgpl|library general public license)(?: version)? v?2(?: 0)?"),
    "lgpl-2.1": ("lgpl|lesser", "(?:gnu )?(?:lgpl|lesser general public license)(?: version)? v?2 1"),
    "lgpl-3": ("lgpl|lesser", "(?:gnu )?(?:lgpl|lesser general public license)(?: version)? v?3(?: 0)?"),
    "lgpl": ("lgpl|lesser|library", "(?:gnu )?(?:lgpl|(?:lesser|library) general public license)"),
    "agpl-3": ("agpl|affero", "(?:gnu )?(?:agpl|affero general public license)(?: version)? v?3(?: 0)?"),
    "agpl": ("agpl|affero", "(?:gnu )?(?:agpl|affero general public license)"),
    "gfdl": ("gfdl|documentation", "(?:gfdl|gnu free documentation license)"),
    "mpl-1": ("mpl|mozilla", "(?:mpl|mozilla public license)(?: version)? 1(?: [01])?"),
    "mpl-2": ("mpl|mozilla", "(?:mpl|mozilla public license)(?: version)? 2(?: 0)?"),
    "epl-1": ("epl|eclipse", "(?:epl|eclipse public license)(?: version)? 1(?: 0)?"),
    "epl-2": ("epl|eclipse", "(?:epl|eclipse public license)(?: version)? 2(?: 0)?"),
    "eupl": ("eupl|european", "(?:eupl|european union public licen[cs]e)"),
    "cddl": ("cddl|development", "(?:cddl|common development and distribution license)"),
    "cpl": ("common", "common public license"),
    "artistic-1": ("artistic", "artistic(?: license)?(?: version)? 1(?: 0)?"),
    "artistic-2": ("artistic", "artistic(?: license)?(?: version)? 2(?: 0)?"),
    "artistic": ("artistic", "artistic"),
    "boost": ("boost|bsl", "(?:boost software|bsl 1 0)"),
    "zlib": ("zlib", "zlib(?: libpng)?"),
    "unlicense": ("unlicense", "unlicense"),
    "wtfpl": ("wtfpl", "wtfpl"),
    "psf": ("python", "python software foundation"),
    "postgresql": ("postgresql", "postgresql"),
    "ofl": ("ofl|font", "(?:sil )?(?:ofl|open font)(?: license)?(?: version)?(?: 1 1)?"),
    "cc0": ("cc0|zero", "(?:cc0|creative commons zero)(?: 1 0)?"),
    "cc-by": ("cc|commons", "(?:cc by|creative commons attribution)(?: [1-4] 0)?"),
    "cc-by-sa": ("cc|commons", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?"),
    "cc-by-nd": ("cc|commons", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] 0)?"),
    "cc-by-nc": ("cc|commons", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] 0)?"),
    "cc-by-nc-sa": ("cc|commons", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] 0)?"),
    "cc-by-nc-nd": ("cc|commons", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] 0)?"),
    "openrail": ("openrail|rail", "(?:creativeml )?open ?rail(?: [ms])?"),
    "proprietary": ("proprietary", "proprietary"),
}

#: How a license is declared, by how sure that is; ``{}`` is its name. The more specific come first.
SETTINGS = (
    (0.99, "spdx license identifier {}"),
    (0.97, "licensed under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (0.95, "(?:re)?(?:leased|distributed|published|available|modify it|modified) under (?:the )?(?:terms of (?:the )?)?{}(?: licen[cs]e)?"),
    (0.9, "under (?:the )?(?:terms of (?:the )?)?{} licen[cs]e"),
    (0.85, "(?:governed by|covered by|subject to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{}(?: licen[cs]e)?"),
    (0.8, "licen[cs]e (?:is )?(?:the )?{}"),
    (0.6, "(?:the )?{} licen[cs]e"),
)

#: A license in these words is no license of the text: a name followed by one of them, and a declaration after a denial.
_NOT_A_LICENSE = "(?! (?:plates?|numbers?|keys?|servers?|fees?|holders?|office) )"
_DENIAL = re.compile(r" (?:not|never|nor|neither|cannot|(?:is|are|was|were|can|could|may|must|should|will)n t)(?: be| been| yet| currently| longer| itself)? $")
#: Characters before a declaration that may hold a denial.
_DENIED_WITHIN = 40

#: Settings that end with the word license, which a name written out has itself.
_TAILED = tuple(i for i, (_, setting) in enumerate(SETTINGS) if setting.endswith("{} licen[cs]e"))

#: Tables of signatures, how sure each is, and what may stand before a match.
SIGNATURES = (
    (0.99, signatures.WHOLE, ""),
    (0.98, signatures.LATER, "(?:(?:licensed|released|distributed|published|available) )?(?:under )?(?:the )?(?:terms of )?(?:the )?"),
    (0.96, signatures.BODIES, ""),
    (0.92, signatures.NOTICES, ""),
)
_SPDX_ID = "|".join(sorted(signatures.SPDX, key=len, reverse=True))
#: An expression of identifiers; each of them is a finding.
SPDX = re.compile(f"(?<= )spdx license identifier (?:{_SPDX_ID})(?: (?:and|or|with) (?:{_SPDX_ID}))*(?= )")
_SPDX_PART = re.compile(f"(?<= )(?:spdx license identifier |and |or |with )?(?P<id>{_SPDX_ID})(?= )")
SPDX_SURE = 0.995
#: Without any of these none of the settings can match.
_STEMS = ("licen", "spdx", "cc by", "leased under", "distributed under", "published under", "available under", "governed by", "covered by", "modify it under", "modified under", "subject to")
#: Characters in a block of the index of findings already taken.
_BLOCK = 256
_WORDS = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    """A signature: ``order`` is its priority, the smallest first."""

    order: int
    label: str
    sure: float
    keywords: tuple[str, ...]
    pattern: re.Pattern[str]


def _versioned(name: str) -> str:
    """With the ways to write a version: version 2, v2, v 2 0, gplv2, and that of the GNU notices."""
    notice = "(?: as published by the free software foundation(?: either)?)?" if "general public" in name else ""
    return re.sub(r"\(\?: version\)\? (?:v\?)?([0-9])", lambda m: f"{notice}(?: version)?(?: ?v)? ?{m[1]}", name)


def _written(name: str) -> str | None:
    """The name without its abbreviation, if the word license is in it."""
    out = re.sub(r"\(\?:[a-z]+\|((?:[a-z]+ |\(\?:[a-z|]+\) )+licen(?:se|\[cs\]e))\)", r"\1", name).replace("(?: license)?", " license")
    return out if "licen" in out and out != "unlicense" else None


_GAP = re.compile(r"~(\d+) ")


def _gap(m: re.Match[str]) -> str:
    return f"(?:[^ ]+ ){{0,{m[1]}}}?"


@cache
def gate() -> tuple[str, ...]:
    """Without any of these no rule and no phrase can match; keywords that hold another one are left out."""
    keys = {*_STEMS, *(k for _, text, _ in SIGNATURES for _, k, _ in signatures.read(text))}
    return tuple(sorted(k for k in keys if not any(x != k and x in k for x in keys)))


@cache
def rules() -> tuple[Rule, ...]:
    """Every license's name in every setting, most certain setting first, and the signatures written by hand, in their order."""
    made = []
    for i, (sure, setting) in enumerate(SETTINGS):
        for label, (keys, name) in NAMES.items():
            said = setting.format(_versioned(name))
            if i in _TAILED and (written := _written(name)):
                said += "|" + setting.removesuffix(" licen[cs]e").format(_versioned(written))
            made.append((sure, label, keys, f"(?<= )(?:{said})(?= ){_NOT_A_LICENSE}"))
    for sure, text, before in SIGNATURES:
        made += [(sure, label, key, f"(?<= ){before}(?:{_GAP.sub(_gap, words)})(?= )") for label, key, words in signatures.read(text)]
    return tuple(Rule(i, label, sure, tuple(keys.split("|")), re.compile(p)) for i, (sure, label, keys, p) in enumerate(made))


@dataclass(frozen=True)
class Finding:
    label: str
    sure: float
    start: int
    end: int  # word positions, end exclusive
    order: int


def words_of(text: str) -> tuple[str, int]:
    """The text's words, lowered, between single spaces; and how many they are."""
    found = text.encode("utf-8", "surrogatepass").translate(_WORDS).split()
    return (b" " + b" ".join(found) + b" ").decode("utf-8", "surrogatepass"), len(found)


def scan(line: str) -> list[Finding]:
    """Findings of the rules in a line of words, after suppression, by start."""
    found, present = [], {}
    for rule in rules():
        for k in rule.keywords:
            if k not in present:
                present[k] = k in line
        if any(present[k] for k in rule.keywords):
            found += [(rule.order, m.start(), m.end(), rule) for m in rule.pattern.finditer(line)]
    if "spdx license identifier" in line:
        for m in SPDX.finditer(line):
            found += [(-1, x.start(), x.end(), _spdx(x["id"])) for x in _SPDX_PART.finditer(line, m.start(), m.end() + 1)]
    # Between rules of one setting the longest finding goes first.
    found.sort(key=lambda x: (-x[3].sure, x[1] - x[2], x[0], x[1]))
    taken: dict[int, list[tuple[int, int]]] = defaultdict(list)
    kept = []
    for _, a, b, rule in found:
        if not any(x <= a and b <= y for x, y in taken[a // _BLOCK]):
            if not denied(line, a, rule):
                kept.append((a, b, rule))
            for block in range(a // _BLOCK, b // _BLOCK + 1):
                taken[block].append((a, b))
    kept.sort(key=lambda x: (x[0], x[2].order))
    starts = _word_positions(line, [a - 1 for a, _, _ in kept])
    return [Finding(r.label, r.sure, n, n + line.count(" ", a, b) + 1, r.order) for n, (a, b, r) in zip(starts, kept, strict=True)]


def denied(line: str, start: int, rule: Rule) -> bool:
    """Whether the words before a name in a setting say that it does not hold; signatures and identifiers can't be denied."""
    return 0 <= rule.order < len(SETTINGS) * len(NAMES) and _DENIAL.search(line[max(0, start - _DENIED_WITHIN) : start]) is not None


@cache
def _spdx(words: str) -> Rule:
    return Rule(-1, signatures.SPDX[words], SPDX_SURE, (), SPDX)


def _word_positions(line: str, spaces: list[int]) -> list[int]:
    """Which word follows the space at each of these ascending places."""
    out, at, n = [], 0, 0
    for s in spaces:
        n, at = n + line.count(" ", at, s), s
        out.append(n)
    return out


def places(line: str) -> list[tuple[int, str]]:
    """Word positions of the contract's phrases with their labels, overlapping ones included."""
    found = []
    for phrase, label in PHRASES.items():
        at = line.find(f" {phrase} ")
        while at >= 0:
            found.append((at, label))
            at = line.find(f" {phrase} ", at + 1)
    found.sort()
    return list(zip(_word_positions(line, [at for at, _ in found]), [label for _, label in found], strict=True))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, places, findings)`` for every row, without a shuffle.

    ``places`` are the fixed phrases ``(word, label)``; ``findings`` the rules' results
    ``(label, sure, start, end)`` in word positions. Null texts count as empty; every
    row keeps its own result; an empty table gives no rows.
    """
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    finding = pa.list_(pa.struct([("label", pa.string()), ("sure", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        def one(text: str) -> tuple[int, list, list]:
            line, n = words_of(text)
            if not any(g in line for g in gate()):
                return n, [], []
            return n, [{"word": w, "label": x} for w, x in places(line)], [{"label": f.label, "sure": f.sure, "start": f.start, "end": f.end} for f in scan(line)]

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, base, more = zip(*[one(t or "") for t in batch.column("text").to_pylist()], strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, place), pa.array(more, finding)], ["doc_id", "n_words", "places", "findings"])

        return kernel

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "doc_id long, n_words long, places array<struct<word:long,label:string>>, findings array<struct<label:string,sure:double,start:long,end:long>>")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """Every document's license phrases, labels and certainty."""
    found = licenses(table(spark, sf_dir, "documents"))
    base, more = F.col("places.label"), F.col("findings.label")
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    sure = F.greatest(F.when(F.size("places") > 0, 0.9).otherwise(0.0), F.coalesce(F.array_max("findings.sure"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), sure.alias("score"), F.size("findings").cast("long").alias("n_findings"),
    )
