"""Secret scans with multipart credential linking.

Strong patterns (assignments, access key ids, long hexadecimal runs) are reported
wherever they match. Weak candidates, an account name, a token-like run or an endpoint
address, say nothing alone: their spans are interval-joined with the complementary
parts of their scope, and a weak candidate is reported only as part of a credential that
has both an identifier or endpoint and a secret.

A scope is the innermost pair of braces around a part, or outside of braces the lines
between two blank lines; a scope also sees what stands directly in the scope around it.
An access key id and the 40 characters of its secret belong together anywhere in a
section, that is between two headings. What code is full of is no part: names and paths
that only look like tokens, calls, addresses within a sentence, and digests that are
called so.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import map_rows, table

#: Fixed values of the contract, in the order in which kinds are listed: patterns and the shortest match kept.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
SHORTEST = {"assign": 8, "access": 16, "hex": 32}
#: A run of the shortest length or more is the maximal run itself.
HEX = re.compile(r"[0-9a-f]{32,}")

#: Weak candidates: identifiers by their names, endpoints, token-like runs.
NAMED = re.compile(r"""(?<![A-Za-z0-9_])(?:access_?key(?:_?id)?|client_?id|account(?:_?(?:id|name))?|user(?:_?(?:id|name))?|login|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"""(?:https?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3)://[^\s"'<>]+""", re.ASCII)
KEYLIKE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
IDENTIFIERS, SECRETS = {"access", "identifier"}, {"assign", "hex", "key"}
WEAK = {"identifier", "key", "endpoint"}
#: Code points between two parts of one credential, for callers of ``linked`` that want a window; the query and the pipeline link over whole scopes.
WINDOW = 400
_BRACE = re.compile(r"[{}]")
_EDGE = re.compile(r"[{}]|\n(?=[^\S\n]*\n)")
_HEADING = re.compile(r"^(?:\[[^\]\n]+\]|#{1,6} [^\n]*|-{3,}|={3,})[^\S\n]*$", re.MULTILINE)
#: Addresses that are often only mentioned.
WEB = re.compile(r"(?:https?|wss?)://(?![^/\s]*@)")
#: What stands before a hexadecimal run that is no secret.
DIGEST = re.compile(r"""(?:sha-?\d*|md5|hash|digest|checksum|commit|revision|etag|uuid)["']?\s*[:=-]\s*["']?$""", re.IGNORECASE)
#: Characters of the secret that goes with an access key id.
AWS_SECRET = 40
_HEX_ONLY = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))


@dataclass(frozen=True, order=True)
class Span:
    start: int
    rank: int
    end: int
    kind: str

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def _span(kind: str, start: int, end: int) -> Span:
    return Span(start, KINDS.index(kind), end, kind)


def strong(text: str) -> list[Span]:
    """The contract's spans, by start and then kind as listed. Cheap literal tests come before each pattern."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "key")) and ("=" in text or ":" in text):
        out += [_span("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [_span("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST["access"]]
    if b"x" * SHORTEST["hex"] in text.encode("utf-8", "surrogatepass").translate(_HEX_ONLY):
        out += [_span("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _token_like(text: str, start: int, end: int) -> bool:
    """Whether a run looks drawn at random: words, names and paths have many lower-case letters next to each other."""
    run = text[start:end].rstrip("=")
    if len(set(run)) < 10:
        return False
    if text[end : end + 1] == "(" or (text[end : end + 1] == "." and text[end + 1 : end + 2].isalpha()):
        return False  # a call, or a file or member
    pairs = sum(a.islower() and b.islower() for a, b in pairwise(run))
    return pairs < 0.4 * (len(run) - 1)


def _is_value(text: str, start: int, end: int) -> bool:
    """Whether a span is assigned to something, or alone on its line."""
    line = text.rfind("\n", 0, start) + 1
    before = text[max(line, start - 8) : start].rstrip(" \"'")
    after = text[end : end + 1]
    return before.endswith(("=", ":")) or (not text[line:start].strip() and after in ("", "\n", "\r"))


def _weak(text: str, sure: list[Span]) -> list[Span]:
    low, out = text.lower(), []
    if any(k in low for k in ("key", "client", "account", "user", "login", "tenant")) and ("=" in text or ":" in text):
        out += [_span("identifier", m.start(), m.end()) for m in NAMED.finditer(text) if text[m.end() : m.end() + 1] != "("]
    if "://" in text:
        out += [_span("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text) if not WEB.match(m[0]) or _is_value(text, m.start(), m.end())]
    if out or any(s.kind == "access" for s in sure):
        out += [_span("key", m.start(), m.end()) for m in KEYLIKE.finditer(text) if _token_like(text, m.start(), m.end())]
    if not out:
        return []
    # A weak part within a strong one is that part itself.
    ends, top = [], -1
    for s in sure:
        top = max(top, s.end)
        ends.append(top)
    starts = [s.start for s in sure]
    return [w for w in out if (i := bisect_left(starts, w.start + 1)) == 0 or ends[i - 1] < w.end]


def _scopes(text: str) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """``(places, numbers, around)``: from each place on, the number of the innermost scope, and each scope's number and that around it.

    Scopes outside of braces are paragraphs, one for each blank line before; braces
    that don't match are none.
    """
    pairs, open_ = {}, []
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            pairs[open_.pop()] = m.start()
    closing = set(pairs.values())
    places, numbers, parents, stack = [0], [0], [(0, -1)], [0]
    for m in _EDGE.finditer(text):
        at = m.start()
        if at in pairs:
            parents.append((len(parents), stack[-1]))
            stack.append(len(parents) - 1)
        elif at in closing:
            stack.pop()
        elif m[0][0] == "\n" and len(stack) == 1:
            parents.append((len(parents), -1))
            stack[0] = len(parents) - 1
        else:
            continue
        places.append(at)
        numbers.append(stack[-1])
    return places, numbers, parents


@dataclass(frozen=True)
class Side:
    """The spans of one side of a credential, by start; ``tops`` is the largest end up to each."""

    starts: list[int]
    tops: list[int]

    @classmethod
    def of(cls, spans: list[Span]) -> Side:
        return cls([s.start for s in spans], list(accumulate((s.end for s in spans), max)))

    def meets(self, part: Span, window: int) -> bool:
        """Whether one of the spans lies within ``window`` of ``part``: of those that start early enough, the one that ends last."""
        i = bisect_right(self.starts, part.end + window)
        return i > 0 and self.tops[i - 1] >= part.start - window


def linked(text: str, sure: list[Span], window: int | None = WINDOW) -> list[Span]:
    """The weak candidates that belong to a credential; without a window its parts may lie anywhere in their scopes."""
    window = len(text) if window is None else window
    weak = _weak(text, sure)
    if not weak:
        return []
    places, numbers, around = _scopes(text)
    here: dict[tuple[str, int], list[Span]] = {}
    below: dict[tuple[str, int], list[Span]] = {}
    where: dict[Span, int] = {}
    for s in sorted(sure + weak):
        scope = where[s] = numbers[bisect_right(places, s.start) - 1]
        if s.kind == "hex" and DIGEST.search(text, max(0, s.start - 40), s.start):
            continue
        side = "secret" if s.kind in SECRETS else "name"
        here.setdefault((side, scope), []).append(s)
        below.setdefault((side, around[scope][1]), []).append(s)
    here, below = ({k: Side.of(v) for k, v in t.items()} for t in (here, below))
    out = []
    for s in weak:
        other, scope = "name" if s.kind == "key" else "secret", where[s]
        sides = [here.get((other, scope)), below.get((other, scope)), here.get((other, around[scope][1]))]
        if any(x is not None and x.meets(s, window) for x in sides):
            out.append(s)
    # An access key id and its secret, anywhere in a section.
    heads = [m.start() for m in _HEADING.finditer(text)] if any(s.kind == "access" for s in sure) else []
    ids = {bisect_right(heads, s.start) for s in sure if s.kind == "access"}
    given = set(out)
    out += [s for s in weak if s.kind == "key" and s.end - s.start == AWS_SECRET and s not in given and bisect_right(heads, s.start) in ids]
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = None) -> DataFrame:
    """``(doc_id, base, more)`` for every row, without a shuffle: spans ``(kind, start, end)`` in code points.

    ``base`` are the strong patterns' spans, ``more`` the linked weak candidates; both
    by start and then kind. Null texts count as empty; every row, repeated ids too,
    keeps its own result; an empty table gives no rows.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    as_rows = lambda spans: [{"kind": s.kind, "start": s.start, "end": s.end} for s in spans]

    def make():
        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            base, more = [], []
            for t in batch.column("text").to_pylist():
                found = strong(t or "")
                base.append(as_rows(found))
                more.append(as_rows(sorted(linked(t, found, window)) if t else []))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, span), pa.array(more, span)], ["doc_id", "base", "more"])

        return kernel

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "array<struct<kind:string,start:long,end:long>>"
    return map_rows(rows, make, f"doc_id long, base {kind}, more {kind}")


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the strong patterns, and all spans."""
    found = secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.transform(F.sort_array(F.transform(F.concat("base", "more"), lambda s: F.struct(s["start"], order[s["kind"]], s["end"], s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"), F.size("more").cast("long").alias("n_linked"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int | None = None) -> DataFrame:
    """The rows with all their columns, each span of the text replaced by ``[kind]``."""
    columns = docs.columns

    def make():
        def clean(text: str) -> str:
            out, at = [], 0
            found = strong(text)
            for s in sorted(found + linked(text, found, window)):
                if s.start >= at:
                    out += [text[at : s.start], f"[{s.kind}]"]
                at = max(at, s.end)
            return "".join([*out, text[at:]]) if out else text

        def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
            i = batch.schema.get_field_index(text_col)
            new = pa.array([t if t is None else clean(t) for t in batch.column(i).to_pylist()], pa.string())
            return batch.set_column(i, batch.schema.field(i), new.cast(batch.schema.field(i).type))

        return kernel

    return map_rows(docs.select(*columns), make, docs.schema, text_col)
