"""Script-variant detection: over whole Arrow batches, or wholly in Catalyst expressions.

Both follow the same rules. Batches look every character up once in a table of
classes and find all phrases in one pass; the expressions need no Python
worker, but go over the text once for every class and phrase.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glyphflow.operators import vector
from glyphflow.operators.matching import parse_line
from glyphflow.sources.dictionaries import MissingDictionary, Registry

#: Bytes that detection of files looks at.
SAMPLE_BYTES = 4096


def is_cjk(c: str) -> bool:
    return "一" <= c <= "鿿"


def _entries(registry: Registry, name: str, allow_missing: bool):
    try:
        lines = registry.lines(name)
    except MissingDictionary:
        if not allow_missing:
            raise
        return []
    return [e for line in lines if (e := parse_line(line))]


def signatures(registry: Registry | None = None, allow_missing: bool = True) -> dict[str, str]:
    """Characters (of the unified block) that speak for each variant."""
    registry = registry or Registry()
    keys = lambda name, changed: {c for k, v in _entries(registry, name, allow_missing) if not changed or v[0] != k for c in k}
    found = {
        "cn_s": keys("STCharacters", True),
        "cn_t": keys("TSCharacters", True),
        "cn_tw": keys("TWVariants", False),
        "cn_hk": keys("HKVariants", False),
        "jp_n": keys("JPShinjitaiCharacters", False),
        "jp_t": {c for _, v in _entries(registry, "JPShinjitaiCharacters", allow_missing) for c in v[0]},
    }
    return {k: "".join(sorted(filter(is_cjk, v))) for k, v in found.items()}


def phrases(name: str, registry: Registry | None = None) -> list[tuple[str, int]]:
    """(phrase, weight): first values of at least two characters; one that repeats weighs more."""
    counts = Counter(v[0] for _, v in _entries(registry or Registry(), name, True) if len(v[0]) >= 2)
    return [(p, n * len(p)) for p, n in counts.items()]


def regional_phrases(registry: Registry | None = None) -> tuple[list[tuple[str, int]], list[tuple[str, int]], list[tuple[str, int]]]:
    """Weighted phrases of Taiwan alone, of Hong Kong alone, and of both (as Taiwan's list has them)."""
    tw, hk = phrases("TWPhrases", registry), phrases("HKPhrases", registry)
    in_tw, in_hk = {p for p, _ in tw}, {p for p, _ in hk}
    return [x for x in tw if x[0] not in in_hk], [x for x in hk if x[0] not in in_tw], [x for x in tw if x[0] in in_hk]


def tally(text: Column, chars: str) -> Column:
    """How many of the text's characters are among chars."""
    return F.length(text) - F.length(F.translate(text, chars, "")) if chars else F.lit(0)


def tallies(text: Column | str, registry: Registry | None = None, allow_missing: bool = True) -> dict[str, Column]:
    text = F.col(text) if isinstance(text, str) else text
    out = {k: tally(text, v) for k, v in signatures(registry, allow_missing).items()}
    out["cjk"] = F.regexp_count(text, F.lit("[一-鿿]"))
    out["kana"] = F.regexp_count(text, F.lit("[぀-ヿ]"))
    return out


def phrase_score(text: Column, weighted: list[tuple[str, int]]) -> Column:
    """Summed weights of the phrases that the text contains, however often."""
    if not weighted:
        return F.lit(0)
    # A phrase stands as often as its weight has its length; the split folds to one array literal.
    listed = F.split(F.lit("|".join(p for p, w in weighted for _ in range(w // len(p)))), "\\|")
    return F.aggregate(listed, F.lit(0), lambda a, p: a + F.when(text.contains(p), F.length(p)).otherwise(0))


def percent(part: Column, total: Column) -> Column:
    """Whole percent, modulo 256 as a byte would hold it; 0 of nothing."""
    return F.when(total == 0, 0).otherwise(F.floor(part * 100 / total).cast("int").bitwiseAND(255))


def decide(t: dict[str, Column], tw: Column, hk: Column, shared: Column) -> Column:
    """The rules, in order, over tallies and phrase scores; null where nothing is detected."""
    both = t["jp_n"] + t["jp_t"]
    trad = t["cn_t"] + t["cn_tw"] + t["cn_hk"]
    said = lambda region, confidence: F.struct(F.lit(region).alias("region"), confidence.cast("int").alias("confidence"))
    at_least = lambda n, x: F.greatest(F.lit(n), x)
    in_tw, in_hk = percent(t["cn_t"] + t["cn_tw"], t["cjk"]), percent(t["cn_t"] + t["cn_hk"], t["cjk"])
    return (
        F.when((t["kana"] > 0) & (both == 0), said("jp-n", F.lit(50)))
        .when((t["kana"] > 0) & (t["jp_n"] >= t["jp_t"]), said("jp-n", percent(t["jp_n"], both)))
        .when(t["kana"] > 0, said("jp-t", percent(t["jp_t"], both)))
        .when(t["cjk"] == 0, F.lit(None))
        .when(tw > hk, said("cn-tw", at_least(50, in_tw)))
        .when(hk > tw, said("cn-hk", at_least(50, in_hk)))
        .when((tw == hk) & ((shared > 0) | (tw > 0)), said("cn-tw", at_least(40, in_tw)))
        .when(t["cn_s"] > trad, said("cn-s", percent(t["cn_s"], t["cjk"])))
        .when((t["cn_tw"] >= t["cn_hk"]) & (2 * t["cn_tw"] >= t["cn_t"] + t["cn_tw"]) & (t["cn_tw"] > 0), said("cn-tw", in_tw))
        .when((t["cn_hk"] > t["cn_tw"]) & (2 * t["cn_hk"] >= t["cn_t"] + t["cn_hk"]) & (t["cn_hk"] > 0), said("cn-hk", in_hk))
        .otherwise(said("cn-t", percent(trad, t["cjk"])))
    )


#: Classes of characters, in the order of their bits.
CLASSES = ("cjk", "kana", "cn_s", "cn_t", "cn_tw", "cn_hk", "jp_n", "jp_t")


class Detector:
    """Detection of many texts at once."""

    def __init__(self, registry: Registry | None = None, allow_missing: bool = True):
        self.signatures = signatures(registry, allow_missing)
        tw, hk, both = regional_phrases(registry)
        self.index = vector.Index([p for p, _ in (*tw, *hk, *both)])
        self.weight = np.array([w for _, w in (*tw, *hk, *both)], np.int64)
        self.owner = np.repeat([0, 1, 2], [len(tw), len(hk), len(both)])
        self._classes = self._table()

    def _table(self) -> np.ndarray:
        out = np.zeros(0x110000, np.uint8)
        out[0x4E00:0xA000] |= 1
        out[0x3040:0x3100] |= 2
        for k, name in enumerate(CLASSES[2:], 2):
            out[[ord(c) for c in self.signatures[name]]] |= 1 << k
        return out

    def __getstate__(self):
        return self.__dict__ | {"_classes": None}

    def __setstate__(self, state):
        self.__dict__ = state
        self._classes = self._table()

    def detect(self, texts: pa.Array) -> pa.Array:
        """struct<region, confidence> of each text."""
        return pa.concat_arrays([self._part(part) for part in vector.parts_of(texts)])

    def tallies(self, batch: vector.Batch) -> dict[str, np.ndarray]:
        """Characters of each class, and the scores of Taiwan's, Hong Kong's and common phrases, by row."""
        n = len(batch.rows) - 1
        row = np.repeat(np.arange(n), np.diff(batch.rows))
        met = np.bincount(row * 256 + self._classes[batch.codes], minlength=n * 256).reshape(n, 256)
        bits = np.arange(256)
        out = {name: met[:, (bits >> k & 1) == 1].sum(axis=1) for k, name in enumerate(CLASSES)}
        position, key = self.index.search(batch.codes, batch.room(), every=True)
        pairs = np.unique(row[position] * max(len(self.weight), 1) + key)  # a phrase counts once a text
        row, key = pairs // max(len(self.weight), 1), pairs % max(len(self.weight), 1)
        for k, name in enumerate(("tw", "hk", "both")):
            mine = self.owner[key] == k
            out[name] = np.bincount(row[mine], self.weight[key[mine]], n).astype(np.int64)
        return out

    def _part(self, texts: pa.Array) -> pa.Array:
        if not len(texts) or pc.all(pc.fill_null(pc.string_is_ascii(texts), True)).as_py():
            return pa.nulls(len(texts), DETECTION)
        region, confidence = decided(self.tallies(vector.batch_of(texts)))
        region[~np.asarray(texts.is_valid())] = None
        none = np.array([r is None for r in region])
        return pa.StructArray.from_arrays(
            [pa.array(region, pa.string()), pa.array(confidence, pa.int32(), mask=none)], fields=list(DETECTION), mask=pa.array(none)
        )


DETECTION = pa.struct([("region", pa.string()), ("confidence", pa.int32())])


def decided(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rules, in order, over arrays of tallies: regions (None where nothing is detected) and confidences."""
    pct = lambda part, total: np.where(total == 0, 0, part * 100 // np.maximum(total, 1) & 255)
    both, trad = t["jp_n"] + t["jp_t"], t["cn_t"] + t["cn_tw"] + t["cn_hk"]
    in_tw, in_hk = pct(t["cn_t"] + t["cn_tw"], t["cjk"]), pct(t["cn_t"] + t["cn_hk"], t["cjk"])
    rules = [
        ((t["kana"] > 0) & (both == 0), "jp-n", np.full(len(both), 50)),
        ((t["kana"] > 0) & (t["jp_n"] >= t["jp_t"]), "jp-n", pct(t["jp_n"], both)),
        (t["kana"] > 0, "jp-t", pct(t["jp_t"], both)),
        (t["cjk"] == 0, None, both * 0),
        (t["tw"] > t["hk"], "cn-tw", np.maximum(50, in_tw)),
        (t["hk"] > t["tw"], "cn-hk", np.maximum(50, in_hk)),
        ((t["both"] > 0) | (t["tw"] > 0), "cn-tw", np.maximum(40, in_tw)),
        (t["cn_s"] > trad, "cn-s", pct(t["cn_s"], t["cjk"])),
        ((t["cn_tw"] >= t["cn_hk"]) & (2 * t["cn_tw"] >= t["cn_t"] + t["cn_tw"]) & (t["cn_tw"] > 0), "cn-tw", in_tw),
        ((t["cn_hk"] > t["cn_tw"]) & (2 * t["cn_hk"] >= t["cn_t"] + t["cn_hk"]) & (t["cn_hk"] > 0), "cn-hk", in_hk),
        (np.ones(len(both), bool), "cn-t", pct(trad, t["cjk"])),
    ]
    which = np.argmax(np.stack([c for c, _, _ in rules]), axis=0)
    regions = np.array([r for _, r, _ in rules], object)[which]
    return regions, np.stack([x for _, _, x in rules])[which, np.arange(len(both))]


def detect(text: Column | str, registry: Registry | None = None, allow_missing: bool = True, strategy: str = "arrow") -> Column:
    """struct<region, confidence> of the whole text; null without Han characters and kana, and for null.

    Tallies of dictionaries that are missing count zero; with
    allow_missing=False their absence is an error. strategy: arrow, or catalyst.
    """
    text = F.col(text) if isinstance(text, str) else text
    if strategy == "catalyst":
        return _detect_catalyst(text, registry, allow_missing)
    shared = SparkSession.active().sparkContext.broadcast(Detector(registry, allow_missing))

    def run(texts: pa.Array) -> pa.Array:
        return shared.value.detect(texts)

    return F.arrow_udf(run, "struct<region:string,confidence:int>")(text)


def _detect_catalyst(text: Column, registry: Registry | None, allow_missing: bool) -> Column:
    def of(t: Column) -> Column:
        counted = tallies(t, registry, allow_missing)
        # Phrases matter only to texts with Han characters and no kana.
        telling = (counted["kana"] == 0) & (counted["cjk"] > 0)
        scored = {n: F.when(telling, phrase_score(t, w)).otherwise(0) for n, w in zip(("tw", "hk", "both"), regional_phrases(registry), strict=True)}
        figures = F.struct(*(c.alias(k) for k, c in (counted | scored).items()))
        return _bound(figures, lambda x: decide({k: x[k] for k in counted}, x["tw"], x["hk"], x["both"]))

    return F.when(text.isNotNull(), _bound(text, of))


def _bound(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def sample_text(content: Column | str) -> Column:
    """Text of at most 4096 bytes of a binary column, cut back to whole characters; null if it isn't UTF-8."""
    content = F.col(content) if isinstance(content, str) else content
    cuts = [F.try_validate_utf8(F.substring(content, 1, SAMPLE_BYTES - k).cast("string")) for k in range(4)]
    return F.when(F.is_valid_utf8(content.cast("string")), F.coalesce(*cuts))


def detect_bytes(content: Column | str, registry: Registry | None = None) -> Column:
    return detect(sample_text(content), registry)
