"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. One pass over the whole texts finds the base spans (exact patterns with
   their checks) and wider candidates (national phone numbers, secrets,
   account numbers, written-out emails), with each labeler's vote on each:
   pattern, check digits, gazetteers, context words, edges. Only spans, votes
   and features are written.
2. Votes are counted over the whole table by (kind, votes), a bounded domain.
   Expectation-maximisation on these counts estimates every labeler's
   reliability and the posterior of each vote pattern.
3. The posteriors train a logistic span classifier on a bounded sample of
   candidates (SAMPLE, by hash). Wider candidates that it accepts are added;
   base spans always stay; a base match that failed its check never comes back.

Defined cases: a null text is the empty text (and stays null when redacted);
very long texts take time in proportion to their length and spans; spans that
overlap or tie keep the order of kinds, then start; rows repeat as they come; a
table without candidates adds nothing; an empty table gives an empty result;
columns other than those named aren't read, and redacted() returns them as they
are; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import fresh, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret")
#: Bound on the candidates that train the classifier.
SAMPLE = 20_000
ACCEPT = 0.5
#: A labeler that votes is right at least so often in either class; without this EM could take the classes for each other.
LEAST_RIGHT = 0.55
LABELERS = ("pattern", "check", "gazetteer", "context", "edges")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A digit run that fails from its first digit fails from every other, so matches start where runs do.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9+])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_ACCOUNT = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Z0-9])")
_SECRET = re.compile(r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9_+/=.-]{12,200})", re.I)
_WRITTEN = re.compile(r"[A-Za-z0-9._-]{1,64}[\x20]?[\[(]at[\])][\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?[\[(]dot[\])][\x20]?[A-Za-z]{2,24})+", re.I)

_TLDS = set("com org net edu gov io co uk de fr es it nl eu us info biz dev app ai ch at be pl ru cn jp in br".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "36", "38", "60", "64", "65", "35")
_COUNTRIES = set("AD AE AL AT AZ BA BE BG BH BR CH CY CZ DE DK EE ES FI FR GB GE GR HR HU IE IL IS IT KZ LB LI LT LU LV MC MD ME MK MT NL NO PL PT RO RS SE SI SK SM TN TR UA".split())
_FOR = {
    "email": "mail email contact write reach e-mail correo courriel".split(),
    "ip": "ip host server address addr client from login".split(),
    "card": "card visa mastercard amex credit pay payment tarjeta carte karte".split(),
    "phone": "call phone tel mobile cell fax telefon teléfono téléphone whatsapp dial".split(),
    "account": "iban account konto cuenta compte bank".split(),
    "secret": "token secret password passwd key api credential".split(),
}
_AGAINST = set("version ver v isbn issn section chapter page pages release build doi figure table".split())
_WORD = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain; each '@' is tried once, from its whole run of local characters."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return out


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def base_matches(text: str):
    """(kind, start, end, passes) of all base matches, by kind and start."""
    out = [("email", s, e, True) for s, e in emails(text)]
    for m in _IP.finditer(text):
        out.append(("ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        out.append(("card", m.start(), m.end(), 13 <= len(d) <= 19 and luhn(d)))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append(("phone", m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15))
    return out


def wider_matches(text: str):
    """(kind, start, end) of candidates beyond the base patterns."""
    out = [("phone", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    out += [("account", m.start(), m.end()) for m in _ACCOUNT.finditer(text)]
    out += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    low = text.lower()
    if "(at)" in low or "[at]" in low:
        out += [("email", m.start(), m.end()) for m in _WRITTEN.finditer(text)]
    return out


def _entropy(x: str) -> float:
    return -sum(n / len(x) * math.log2(n / len(x)) for n in Counter(x).values()) if x else 0.0


def _check(kind: str, span: str) -> int:
    if kind == "card":
        d = _digits(span)
        return 1 if 13 <= len(d) <= 19 and luhn(d) else -1
    if kind == "ip":
        return 1 if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in span.split(".")) else -1
    if kind == "phone":
        return 1 if 9 <= len(_digits(span)) <= 15 else -1
    if kind == "account":
        x = span.replace(" ", "")
        moved = "".join(str(int(c, 36)) for c in x[4:] + x[:4])
        return 1 if 15 <= len(x) <= 34 and int(moved) % 97 == 1 else -1
    if kind == "secret":
        return 1 if _entropy(span) >= 3 and any(c.isdigit() for c in span) else -1
    return 0


def _gazetteer(kind: str, span: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[^a-z]+", span.lower().rstrip(")]"))[-1] in _TLDS else 0
    if kind == "card":
        return 1 if _digits(span).startswith(_ISSUERS) else -1
    if kind == "account":
        return 1 if span[:2] in _COUNTRIES else -1
    if kind == "ip":
        return -1 if span.startswith(("0.", "255.")) else 0
    return 0


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal, -1 not, 0 abstains."""
    span = text[start:end]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 48) : start])[-6:]]
    context = -1 if before and before[-1] in _AGAINST else 1 if any(w in _FOR[kind] for w in before) else 0
    edges = -1 if (start and (text[start - 1].isalnum() or text[start - 1] in "/_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_")) else 1
    return (1 if base else 0, _check(kind, span), _gazetteer(kind, span), context, edges)


def span_features(kind: str, vote: tuple[int, ...], span: str) -> np.ndarray:
    n = max(len(span), 1)
    shape = [
        math.log1p(n) / 4,
        sum("0" <= c <= "9" for c in span) / n,
        sum(c.isalpha() for c in span) / n,
        sum(c.isupper() for c in span) / n,
        sum(c.isspace() for c in span) / n,
        _entropy(span) / 6,
        1.0,
    ]
    return np.array([*(float(kind == k) for k in KINDS), *(float(v == x) for v in vote for x in (-1, 0, 1)), *shape])


N_FEATURES = len(KINDS) + 3 * len(LABELERS) + 7


@dataclass
class Model:
    #: P(vote | class, not abstaining) by labeler, class (0, 1) and vote (-1, 0, 1; 1 for an abstention), from EM.
    reliability: np.ndarray
    prior: dict[str, float]
    weights: np.ndarray

    def accepts(self, features: np.ndarray) -> bool:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(features @ self.weights))))) >= ACCEPT


def posterior(reliability: np.ndarray, prior: float, vote) -> float:
    """P(personal | votes); who abstains says nothing."""
    p1, p0 = math.log(prior), math.log(1 - prior)
    for k, v in enumerate(vote):
        p0 += math.log(reliability[k, 0, v + 1])
        p1 += math.log(reliability[k, 1, v + 1])
    return 1 / (1 + math.exp(max(-60.0, min(60.0, p0 - p1))))


def em(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> tuple[np.ndarray, dict[str, float]]:
    """Labelers' reliabilities, P(vote | class, not abstaining), and the kinds' priors from counts of (kind, votes)."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    v = np.array([k[1] for k in keys], int).reshape(len(keys), len(LABELERS))
    kind = np.array([KINDS.index(k[0]) for k in keys], int)
    q = 1 / (1 + np.exp(-1.5 * v.sum(axis=1)))  # begins as a soft majority
    reliability, prior = np.tile([0.5, 1.0, 0.5], (len(LABELERS), 2, 1)), np.full(len(KINDS), 0.5)
    for _ in range(rounds if len(keys) else 0):
        for y, w in ((0, n * (1 - q)), (1, n * q)):
            for k in range(len(LABELERS)):
                got = np.array([w[v[:, k] == x].sum() for x in (-1, 1)]) + 1
                right = np.clip(got[y] / got.sum(), LEAST_RIGHT, 1 - 1e-3)
                reliability[k, y, [0, 2]] = (1 - right, right) if y else (right, 1 - right)
        prior = np.clip((np.bincount(kind, n * q, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2), 0.02, 0.98)
        ll = np.log(reliability)
        s = [ll[np.arange(len(LABELERS)), y, v + 1].sum(axis=1) for y in (0, 1)]
        q = 1 / (1 + np.exp(np.clip(s[0] - s[1] + np.log(1 - prior[kind]) - np.log(prior[kind]), -60, 60)))
    return reliability, dict(zip(KINDS, prior.tolist(), strict=True))


def train(counts: dict, rows: list[tuple[str, tuple[int, ...], np.ndarray]], ridge: float = 1e-2) -> Model:
    """EM on the counts; its posteriors are the targets of the span classifier."""
    reliability, prior = em(counts)
    w = np.zeros(N_FEATURES)
    if rows:
        x = np.stack([r[2] for r in rows]).astype(float)
        y = np.array([posterior(reliability, prior[r[0]], r[1]) for r in rows])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(N_FEATURES)
            step = np.linalg.solve(h, x.T @ (p - y) / len(x) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
    return Model(reliability, prior, w)


def candidates(text: str):
    """(kind, start, end, state, votes, features) of a text; state is base, failed or wider."""
    out = []
    base = base_matches(text)
    for kind, s, e, passes in base:
        if passes or (kind != "card" or e - s >= 9):
            vote = votes(text, kind, s, e, True)
            out.append((kind, s, e, "base" if passes else "failed", vote, span_features(kind, vote, text[s:e])))
    taken = Taken((s, e) for _, s, e, passes in base if passes)
    for kind, s, e in wider_matches(text):
        if taken.free(s, e):
            vote = votes(text, kind, s, e, False)
            out.append((kind, s, e, "wider", vote, span_features(kind, vote, text[s:e])))
            taken.add(s, e)
    return out


class Taken:
    """Stretches of a text that spans cover, merged and in order."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e)  # the last stretch that begins before e is the only one that can reach past s
        return k == 0 or self.ends[k - 1] <= s

    def add(self, s: int, e: int) -> None:
        """Covers a stretch that was free."""
        k = bisect.bisect_left(self.starts, s)
        self.starts.insert(k, s)
        self.ends.insert(k, e)


_FOUND = "array<struct<kind:string,start:long,end:long,state:string,votes:string,x:binary>>"
_ARROW_FOUND = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("state", pa.string()), ("votes", pa.string()), ("x", pa.binary())])
)


def _found(batch, text_col: str) -> pa.Array:
    return pa.array(
        [
            [
                {"kind": k, "start": s, "end": e, "state": state, "votes": ",".join(map(str, v)), "x": x.astype(np.float32).tobytes()}
                for k, s, e, state, v, x in candidates(t.as_py() or "")
            ]
            for t in batch[text_col]
        ],
        _ARROW_FOUND,
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and its candidates."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], _found(batch, "text")], ["doc_id", "found"])

    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("found", T._parse_datatype_string(_FOUND)))


def fit(scanned: DataFrame, sample: int = SAMPLE) -> Model:
    """From the written result of scan: counts over all candidates, the classifier on a bounded sample."""
    each = scanned.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    parse = lambda v: tuple(int(x) for x in v.split(","))
    # At most kinds * 3 ** labelers rows, whatever the input.
    counts = {(r["kind"], parse(r["votes"])): r["count"] for r in each.groupBy("kind", "votes").count().collect()}
    order = F.xxhash64("doc_id", "start", "kind")
    total = max(sum(counts.values()), 1)
    thin = each.where(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < 2.0 * sample / total)
    rows = thin.orderBy(order, "doc_id", "start", "kind").limit(sample).select("kind", "votes", "x").collect()
    rows = sorted((r["kind"], parse(r["votes"]), bytes(r["x"])) for r in rows)
    return train(counts, [(k, v, np.frombuffer(x, np.float32)) for k, v, x in rows])


def _ordered(spans):
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _join(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def spans(scanned: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, base_sha256, and spans (all, comma-joined)."""
    shared = scanned.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = []
            for found in batch["found"].to_pylist():
                base = _ordered((f["kind"], f["start"], f["end"]) for f in found if f["state"] == "base")
                more = [(f["kind"], f["start"], f["end"]) for f in found if f["state"] == "wider" and shared.value.accepts(np.frombuffer(f["x"], np.float32))]
                n = Counter(k for k, _, _ in base)
                out.append((*(n[k] for k in BASE), hashlib.sha256(_join(base).encode()).hexdigest(), _join(_ordered([*base, *more]))))
            columns = [pa.array([r[k] for r in out], pa.int64() if k < 4 else pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = T.StructType([scanned.schema["doc_id"]])
    for k in BASE:
        kind = kind.add(f"n_{k}", "long")
    return scanned.mapInArrow(run, kind.add("base_sha256", "string").add("spans", "string"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    scanned = written(scan(docs, id_col, text_col))
    return spans(scanned, fit(scanned))


def redact_text(text: str, found) -> str:
    """The text with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs, with their columns, with personal data replaced in the text (and its length renewed).

    Texts are scanned once: rows are written with their candidates, which then
    train the model and, by it, are replaced.
    """
    name, names, schema = fresh(docs, "found"), docs.columns, docs.schema

    def scanned(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _found(batch, text_col)], [*names, name])

    held = written(docs.mapInArrow(scanned, T.StructType([*schema.fields, T.StructField(name, T._parse_datatype_string(_FOUND))])))
    model = fit(held.select(F.col(id_col).alias("doc_id"), F.col(name).alias("found")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def replaced(batches):
        for batch in batches:
            texts = []
            for x, found in zip(batch[text_col].to_pylist(), batch[name].to_pylist(), strict=True):
                got = [(f["kind"], f["start"], f["end"]) for f in found if f["state"] == "base" or f["state"] == "wider" and shared.value.accepts(np.frombuffer(f["x"], np.float32))]
                texts.append(redact_text(x, got) if got else x)
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns[text_col] = pa.array(texts, batch.schema.field(text_col).type)
            if length_col in columns:
                columns[length_col] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(length_col).type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return held.mapInArrow(replaced, schema)
