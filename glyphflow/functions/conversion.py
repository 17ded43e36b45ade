"""Conversion and segmentation as Column functions, and their SQL registrations."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions.detection import Detector, detect
from glyphflow.operators import vector
from glyphflow.operators.matching import Ngrams, segments as segment_text
from glyphflow.plans import configs
from glyphflow.plans.configs import Plan
from glyphflow.sources.dictionaries import Registry

SEGMENTS = "array<struct<seg_no:int,seg:string,matched:boolean>>"


def custom_entries(entries) -> list[tuple[str, str]]:
    """Custom words from a dict, pairs, or text "key value|key value"; none at all is an error."""
    if entries is None:
        return []
    if isinstance(entries, dict):
        if not all(isinstance(x, str) for kv in entries.items() for x in kv):
            raise ValueError("custom words must be strings")
        out = list(entries.items())
    elif isinstance(entries, str):
        out = []
        for k, piece in enumerate(x.strip() for x in entries.split("|")):
            if piece:
                key, space, value = piece.partition(" ")
                if not space or not key:
                    raise ValueError(f"custom word {k} needs a key, a space and a value")
                out.append((key, value.strip()))
    elif isinstance(entries, Iterable):
        out = []
        for k, pair in enumerate(entries):
            pair = list(pair)
            if len(pair) != 2 or not all(isinstance(x, str) for x in pair) or not pair[0]:
                raise ValueError(f"custom word {k} must be a pair of strings with a key")
            out.append((pair[0], pair[1]))
    else:
        raise ValueError("custom words come as a dict, as pairs or as text")
    if not out:
        raise ValueError("there are no custom words")
    return out


def _shared(value):
    return SparkSession.active().sparkContext.broadcast(value)


def _convert_arrow(text: Column, plan: Plan) -> Column:
    shared = _shared(vector.Compiled(plan))

    def run(texts: pa.Array) -> pa.Array:
        return shared.value.convert(texts)

    return F.arrow_udf(run, "string")(text)


def _longest_of(keys) -> str:
    """A pattern of the longest key at a position; halves of the first characters by range, as alternatives would be tried one by one."""
    by_first: dict[str, list[str]] = {}
    for key in sorted(keys, key=len, reverse=True):
        by_first.setdefault(key[0], []).append(key[1:])
    quoted = lambda x: "\\Q" + x + "\\E" if x else ""

    def among(firsts: list[str]) -> str:
        if len(firsts) == 1:
            return f"{firsts[0]}(?:{'|'.join(map(quoted, by_first[firsts[0]]))})"
        half = len(firsts) // 2
        return "|".join(f"(?=[\\x{{{ord(part[0]):x}}}-\\x{{{ord(part[-1]):x}}}])(?:{among(part)})" for part in (firsts[:half], firsts[half:]))

    return f"(?:{among(sorted(by_first))})"


def _any_of(chars) -> str:
    """A class of the characters, halved by range too."""
    chars = sorted(chars)
    if len(chars) < 3:
        return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"
    half = len(chars) // 2
    return "[" + "".join(f"[\\x{{{ord(part[0]):x}}}-\\x{{{ord(part[-1]):x}}}&&{_any_of(part)}]" for part in (chars[:half], chars[half:])) + "]"


def _pieces_of(keys) -> str:
    """A pattern of one group: a key, or all that comes before the next one; most positions are passed by their first two characters."""
    key, first = _longest_of(keys), _any_of({k[0] for k in keys})
    pair = [] if any(len(k) == 1 for k in keys) else [f"(?!{first}{_any_of({k[1] for k in keys})})(?s:.)"]
    return f"((?:{'|'.join([f'[^{first[1:]}++', *pair, f'(?!{key})(?s:.)'])})++|{key})"


def _looked_up(key: Column, values: dict[str, str]) -> Column:
    """The key's value, null if it has none. A map is gone through entry by entry, so there are many, by checksum."""
    parts: list[list[str]] = [[] for _ in range(1 << len(values).bit_length())]
    for k, v in values.items():
        parts[zlib.crc32(k.encode()) % len(parts)] += [k, v]
    maps = F.array(*(F.create_map(*map(F.lit, kv or ["", ""])) for kv in parts))
    return F.element_at(maps, (F.crc32(key) % len(parts)).cast("int") + 1)[key]


def _convert_regex(text: Column, plan: Plan) -> Column:
    """Without Python workers: for one stage of one layer whose keys don't begin with ASCII.

    The text is cut into keys and what lies between them, in which characters
    that become one character are translated.
    """
    values = plan.chain[0].layers[0].values
    if len(plan.chain) != 1 or len(plan.chain[0].layers) != 1 or any(k[0] < "\x80" for k in values):
        raise ValueError("the regex strategy is for one stage, without custom words or keys that begin with ASCII")
    plain = {k: v for k, v in values.items() if len(k) == len(v) == 1}
    others = {k: v for k, v in values.items() if k not in plain}
    translated = lambda x: F.translate(x, "".join(plain), "".join(plain.values()))
    if not others:
        return translated(text)
    found = F.regexp_extract_all(text, F.lit(_pieces_of(others)), F.lit(1))
    return F.array_join(F.transform(found, lambda x: F.coalesce(_looked_up(x, others), translated(x))), "")


def convert(text: Column | str, config: str, custom=None, ngrams: Ngrams | None = None, mode: str = "off", registry: Registry | None = None, strategy: str = "auto", priority: str = "merged") -> Column:
    """The text converted by a named config; null stays null.

    strategy: auto and arrow convert whole Arrow batches with a broadcast plan;
    translate (for plans that are character maps) and regex stay in the JVM.
    """
    plan = configs.resolve(config, registry, custom_entries(custom), ngrams, mode, priority)
    return convert_with(text, plan, strategy)


def convert_with(text: Column | str, plan: Plan, strategy: str = "auto") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    if strategy == "translate":
        table = plan.translation()
        if table is None:
            raise ValueError("this plan is no character map")
        return F.translate(text, "".join(table), "".join(table.values()))
    return {"auto": _convert_arrow, "arrow": _convert_arrow, "regex": _convert_regex}[strategy](text, plan)


def convert_region(text: Column | str, source: str, target: str, **more) -> Column:
    return convert(text, configs.config_for(source, target), **more)


def segments(text: Column | str, config: str, custom=None, registry: Registry | None = None) -> Column:
    """The text's segments, in order, with whether each is a dictionary match; explode() gives a row for each."""
    text = F.col(text) if isinstance(text, str) else text
    shared = _shared(vector.Compiled(configs.resolve(config, registry, custom_entries(custom))))

    def run(texts: pa.Array) -> pa.Array:
        return shared.value.segments(texts)

    return F.arrow_udf(run, SEGMENTS)(text)


def convert_auto(
    text: Column | str, target: str = "cn-s", registry: Registry | None = None, permissive: bool = False, custom=None, ngrams: Ngrams | None = None, mode: str = "off"
) -> Column:
    """Detects each text's region and converts it on the way to target, in one function.

    A region from which there is no way, or whose dictionaries are missing, is
    an error of the row; with permissive such rows stay unchanged.
    """
    text, words = F.col(text) if isinstance(text, str) else text, custom_entries(custom)
    ways: dict[str, list[vector.Compiled] | str] = {}
    compiled: dict[str, vector.Compiled] = {}
    for code in configs.REGIONS:
        chain = configs.route(code, target)
        lacking = list(dict.fromkeys(n for c in chain or [] for n in configs.missing(c, registry)))
        if chain is None or lacking:
            ways[code] = f"no conversion from {code} to {target}" if chain is None else f"{code} to {target} needs {', '.join(lacking)}"
        else:
            for c in chain:
                if c not in compiled:
                    compiled[c] = vector.Compiled(configs.resolve(c, registry, words, ngrams, mode))
            ways[code] = [compiled[c] for c in chain]
    shared = _shared((Detector(registry), ways))

    def run(texts: pa.Array) -> pa.Array:
        detector, ways = shared.value
        return routed(texts, detector.detect(texts).field("region"), ways, permissive)

    return F.arrow_udf(run, "string")(text)


def routed(texts: pa.Array, regions: pa.Array, ways: dict, permissive: bool) -> pa.Array:
    """Each text by its region's way: plans to run in order, or why there are none."""

    def go(region: str | None, part: pa.Array) -> pa.Array:
        way = ways.get(region, [])
        if isinstance(way, str):
            if not permissive:
                raise ValueError(way)
            way = []
        for plan in way:
            part = plan.convert(part)
        return part

    return by_kind(texts, regions, go)


def by_kind(texts: pa.Array, kinds: pa.Array, run) -> pa.Array:
    """run(kind, the texts of that kind) for each kind, put together in the order of the texts."""
    named = kinds.to_pylist()
    each = dict.fromkeys(named)
    if len(each) == 1:
        return run(named[0], texts)
    places = [np.array([k for k, x in enumerate(named) if x == kind], np.int64) for kind in each]
    if not places:
        return run(None, texts)
    done = pa.concat_arrays([run(kind, texts.take(pa.array(at))) for kind, at in zip(each, places, strict=True)])
    return done.take(pa.array(np.argsort(np.concatenate(places), kind="stable")))


class Converter:
    """A config bound once; reusable over columns and frames."""

    def __init__(self, config: str, custom=None, ngrams: Ngrams | None = None, mode: str = "off", registry: Registry | None = None):
        self.config, self._registry, self._ngrams, self._mode = configs.parse_config(config), registry, ngrams, mode
        self.custom = custom_entries(custom)
        self.plan = configs.resolve(config, registry, self.custom, ngrams, mode)

    @classmethod
    def for_region(cls, source: str, target: str, **more) -> Converter:
        return cls(configs.config_for(source, target), **more)

    def with_custom(self, entries) -> Converter:
        return Converter(self.config, custom_entries(entries), self._ngrams, self._mode, self._registry)

    def convert(self, text: str) -> str:
        return self.plan.convert(text)

    def convert_with_custom(self, text: str, entries) -> str:
        return self.with_custom(entries).convert(text)

    def col(self, text: Column | str) -> Column:
        return convert_with(text, self.plan)

    def transform(self, df, column: str, into: str | None = None):
        return df.withColumn(into or column, self.col(column))

    def __repr__(self) -> str:
        return f"Converter({self.config!r}, {len(self.custom)} custom words)"


def register(spark: SparkSession, registry: Registry | None = None) -> list[str]:
    """SQL functions for every config whose dictionaries are there.

    hz_<config>(text); hz_segments_of(text, config), an array for explode();
    the table function hz_segments(text, config), for single texts; and
    hz_detect(text), a struct of region and confidence.
    """
    there = [c for c in configs.CONFIGS if not configs.missing(c, registry)]
    plans = {c: configs.resolve(c, registry) for c in there}

    def converter(shared):
        def run(texts: pa.Array) -> pa.Array:
            return shared.value.convert(texts)

        return F.arrow_udf(run, "string")

    whole = {c: vector.Compiled(plans[c]) for c in there}
    for config in there:
        spark.udf.register(f"hz_{config}", converter(_shared(whole[config])))
    compiled = _shared(whole)

    def cut(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        return by_kind(texts, wanted, lambda config, part: compiled.value[config].segments(part))

    spark.udf.register("hz_segments_of", F.arrow_udf(cut, SEGMENTS))
    detector = _shared(Detector(registry))

    def detected(texts: pa.Array) -> pa.Array:
        return detector.value.detect(texts)

    spark.udf.register("hz_detect", F.arrow_udf(detected, "struct<region:string,confidence:int>"))
    groups = _shared({c: plans[c].segmentation for c in there})

    @F.udtf(returnType="seg_no int, seg string, matched boolean")
    class Segments:
        def eval(self, text: str, config: str):
            group = groups.value[config]
            found = segment_text(group, text or "") if group else [(text, False)] if text else []
            for k, (seg, matched) in enumerate(found):
                yield k, seg, matched

    spark.udtf.register("hz_segments", Segments)
    return [*(f"hz_{c}" for c in there), "hz_segments_of", "hz_detect", "hz_segments"]
