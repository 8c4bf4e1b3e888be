"""The registered queries of this subpackage and the SQL for those that SQL can express.

The results of 11 and 13 are SQL's; what the other operators' methods add is beyond
SQL, so the parts of four results that SQL can state have queries of their own beside
the full ones, through the same operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from kindred.llm.fingerprint import op1_fingerprints
from kindred.llm.languages import op12_languages
from kindred.llm.lexical import op13_lexical_search
from kindred.llm.licenses import op2_licenses
from kindred.llm.mixing import op10_mixing
from kindred.llm.neighbours import op8_neighbours
from kindred.llm.packing import op4_packing
from kindred.llm.periods import op11_periods
from kindred.llm.quality import op5_quality
from kindred.llm.secrets import op6_secrets
from kindred.llm.simhash import op7_simhash
from kindred.llm.tokenfile import op3_token_file
from kindred.llm.toxicity import op9_toxicity

Query = Callable[..., DataFrame]


def edited_texts(spark, sf_dir: str) -> DataFrame:
    """Lengths of all texts and digests of their edited texts, from ``op1_fingerprints``."""
    return op1_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def license_phrases(spark, sf_dir: str) -> DataFrame:
    """Words and places of the fixed phrases, from ``op2_licenses``."""
    return op2_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_counts(spark, sf_dir: str) -> DataFrame:
    """How many secrets of each strong kind every text holds, from ``op6_secrets``."""
    return op6_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mixing_sizes(spark, sf_dir: str) -> DataFrame:
    """Every document's size and its source's size, from ``op10_mixing``."""
    return op10_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM d)
        SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 3) || left(following, length(text) // 3)) AS edited_sha256 FROM f""",
    "license_phrases": f"""WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents), p AS (SELECT * FROM (VALUES (['under', 'the', 'mit', 'license'], 'mit'), (['apache', 'license', 'version', '2'], 'apache-2'), (['cc', 'by', 'nc'], 'cc-by-nc')) t(phrase, label)),
        i AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE list_has_any(words, ['mit', 'apache', 'cc'])), h AS (SELECT doc_id, label, i - 1 AS place FROM i JOIN p ON words[i] = phrase[1] WHERE words[i : i + len(phrase) - 1] = phrase)
        SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id) USING (doc_id)""",
    "secret_counts": f"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
        len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "op13_lexical_search": r"""WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents) GROUP BY ALL),
        d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY 1), s AS (SELECT count(*) AS c, CAST(sum(n) AS BIGINT) AS l FROM d),
        m AS (SELECT doc_id, 75 + (25 * n * c) // l AS m FROM d, s), f AS (SELECT term, CAST(floor(1000 * ln((2 * c + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
        r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (doc_id) GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20""",
    "op11_periods": r"""WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda k: CAST(ascii(k) AS BIGINT))), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) AS h FROM documents),
        b AS (SELECT doc_id, ws, h % 10 = 0 AND len(ws) > 0 AS planted, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) ELSE 0 END AS a, (h // 10) % 8 AS t FROM c),
        d AS (SELECT doc_id, CASE WHEN planted THEN list_transform(range(len(ws)), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(ws) - a) // (3 + t)) END]) ELSE ws END AS ws FROM b),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i, len(ws) AS n FROM d),
        m AS (SELECT x.doc_id, y.i - x.i AS q, x.i AS i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        g AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
        r AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.doc_id = g.doc_id AND o.q < g.q AND o.s <= g.s AND o.s + o.l >= g.s + g.l)),
        f AS (SELECT doc_id, count(*) AS n_runs, first(s ORDER BY l DESC, s, q) AS s, max(l) AS l, first(q ORDER BY l DESC, s, q) AS q, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM r GROUP BY doc_id),
        k AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.l) GROUP BY w.doc_id)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period, CAST(1000 * l // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN f USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "mixing_sizes": r"""SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents)""",
}


def queries() -> dict[str, Query]:
    found = [op1_fingerprints, op2_licenses, op3_token_file, op4_packing, op5_quality, op6_secrets, op7_simhash, op8_neighbours, op9_toxicity, op10_mixing, op11_periods, op12_languages, op13_lexical_search]
    return {f.__name__: f for f in [*found, edited_texts, license_phrases, secret_counts, mixing_sizes]}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
