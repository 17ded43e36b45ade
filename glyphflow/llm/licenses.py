"""License scans by canonical digest lookup.

A text is brought to a canonical form (lower case, no punctuation, no copyright
lines, one spelling of words that are spelt in several ways), hashed whole, and
hash-joined to the digests of known licences. The same lookup runs over the
documents' single lines for known one-line notices.

The known digests are as many as the tables of texts, digests and notices have
entries, so their table is broadcast; no text is shuffled. Further licences and
notices are parameters.

Defined cases: a null text is the empty text and matches nothing; very long
texts are hashed whole; of two names with one digest a text's own goes before a
stated digest's; rows repeat as they come; an empty table gives an empty result;
other columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.license_texts import DIGESTS, KNOWN, NOTICES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Replaced in this order, in lower-cased text; the syntax means the same to Java, RE2 and Python.
STEPS = [
    (r"(?m)^[ \t#*/;-]*(?:copyright[ \t]+(?:\(c\)|©|[0-9<\[{])|\(c\)|©)[^\n]*$", " "),
    (r"(?m)^[ \t#*/;-]*all rights reserved[. \t]*$", " "),
    (r"[\x00-\x1f !-/:-@\[-`{-~\x7f\u2010-\u2015\u2018-\u201f\u2022\u00a0\u00ab\u00bb]+", " "),
    (r"\b(?:sub licen[cs]e|sublicence)", "sublicense"),
    (r"\blicence", "license"),
    (r"\bhttps\b", "http"),
    (r"\bauthorisation\b", "authorization"),
    (r"\borganisation", "organization"),
    (r"\bfavour", "favor"),
    (r"\bnon commercial", "noncommercial"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\bwilful\b", "willful"),
    (r"\bper cent\b", "percent"),
    (r"\bwhile\b", "whilst"),
]


def canonical(text: str) -> str:
    text = text.translate(str.maketrans(_UPPER, _LOWER))
    for pattern, by in STEPS:
        text = re.sub(pattern, by, text, flags=re.ASCII)
    return text.strip(" ")


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def canonical_column(text) -> F.Column:
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def digest_column(text) -> F.Column:
    return F.sha2(canonical_column(text).cast("binary"), 256)


def known_digests(spark, texts: dict[str, str], digests: dict[str, str]) -> DataFrame:
    """(known_digest, known_name) of licences given as texts by name, and as names by digest."""
    rows = sorted((digests | {digest(text): name for name, text in texts.items()}).items())
    return spark.createDataFrame(rows, "known_digest string, known_name string")


#: Words that contain these may be spelt otherwise in a text (see STEPS).
_RESPELT = ("license", "http", "authorization", "organization", "favor", "noncommercial", "merchantability", "willful", "percent", "whilst")


def telling_words(notice: str, most: int = 3) -> list[str]:
    """The longest words of a notice that stand in every line which equals it, as they are but for case."""
    words = {w for w in canonical(notice).split(" ") if w.isascii() and w.isalnum() and not any(x in w for x in _RESPELT)}
    return sorted(words, key=lambda w: (-len(w), w))[:most]


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] = KNOWN, notices: dict[str, str] = NOTICES, digests: dict[str, str] = DIGESTS
) -> DataFrame:
    """Per document: doc_id, license_digest, license_id (null: no known licence), notices.

    license_id names the licence that the whole text is; notices lists, sorted
    and comma-joined, the licences whose notice is a whole line of the text.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pairs = F.create_map(*[F.lit(x) for name, text in notices.items() for x in (digest(text), name)]) if notices else None

    def may_be(line):
        """Whether all telling words of some notice are in the line; most lines needn't be hashed."""
        low, out = F.lower(line), F.lit(False)
        for notice in notices.values():
            out = out | functools.reduce(lambda a, w: a & low.contains(w), telling_words(notice), F.lit(True))
        return out

    def name_of(line):
        return F.when(may_be(line), pairs[digest_column(line)])

    named = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("text", "\n"), name_of), lambda x: x.isNotNull()))) if notices else F.array().cast("array<string>")
    found = whole.select("doc_id", digest_column(F.col("text")).alias("license_digest"), F.array_join(named, ",").alias("notices"))
    table = F.broadcast(known_digests(spark, known, digests))
    return found.join(table, found.license_digest == table.known_digest, "left").select(
        "doc_id", "license_digest", F.col("known_name").alias("license_id"), "notices"
    )


def oracle() -> str:
    """The same in DuckDB SQL over the view documents."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"translate({x}, '{_UPPER}', '{_LOWER}')"
        for pattern, by in STEPS:
            pattern = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)}, 'g')"
        return f"sha256(trim({out}, ' '))"

    values = lambda pairs, more={}: ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in (more | {digest(t): n for n, t in pairs.items()}).items())
    may_be = " OR ".join("(" + " AND ".join(f"contains(lower(line), {quoted(w)})" for w in telling_words(t)) + ")" for t in NOTICES.values())
    return f"""
WITH known(d, name) AS (VALUES {values(KNOWN, DIGESTS)}),
notice(d, name) AS (VALUES {values(NOTICES)}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
named AS (
  SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
  FROM (SELECT doc_id, {form('line')} AS d FROM lines WHERE {may_be}) JOIN notice USING (d)
  GROUP BY doc_id),
whole AS (SELECT doc_id, {form("coalesce(text, '')")} AS d FROM documents)
SELECT doc_id, d AS license_digest, name AS license_id, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (d) LEFT JOIN named USING (doc_id)"""
