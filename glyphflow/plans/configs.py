"""Pipelines, regions and their resolution to plans.

A plan is an optional segmentation group and a chain of groups. Dictionaries
that one group names are merged into one layer (longest match over all, the
last named wins a key); custom words are a layer of their own before it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from glyphflow.operators import matching
from glyphflow.operators.matching import Group, Layer, Ngrams
from glyphflow.sources.dictionaries import MissingDictionary, Registry

_G, _SP, _SC = "STPhrases_GeneratedFromRegionalPhrases", "STPhrases", "STCharacters"
_ST, _ST_SEG, _TS = [_G, _SP, _SC], [_G, _SP], ["TSPhrases", "TSCharactersExt", "TSCharacters"]
_TW, _HK = ["TWVariantsPhrases", "TWVariants"], ["HKVariantsPhrases", "HKVariants"]
_TW_REV, _HK_REV = ["TWVariantsRevPhrases", "TWVariantsRev"], ["HKVariantsRevPhrases", "HKVariantsRev"]

#: name: description, from, to, segmentation (None: the whole text), chain.
CONFIGS: dict[str, tuple[str, str, str, list[str] | None, list[list[str]]]] = {
    "s2t": ("Simplified to Traditional", "cn-s", "cn-t", _ST_SEG, [_ST]),
    "t2s": ("Traditional to Simplified", "cn-t", "cn-s", ["TSPhrases"], [_TS]),
    "s2tw": ("Simplified to Taiwan Traditional", "cn-s", "cn-tw", _ST_SEG, [_ST, _TW]),
    "s2twp": ("Simplified to Taiwan Traditional, with idioms", "cn-s", "cn-tw", _ST_SEG, [_ST, ["TWPhrases", *_TW]]),
    "s2hk": ("Simplified to Hong Kong Traditional", "cn-s", "cn-hk", _ST_SEG, [_ST, _HK]),
    "s2hkp": ("Simplified to Hong Kong Traditional, with idioms", "cn-s", "cn-hk", _ST_SEG, [_ST, ["HKPhrases", *_HK]]),
    "tw2s": ("Taiwan Traditional to Simplified", "cn-tw", "cn-s", ["TSPhrases"], [_TW_REV, _TS]),
    "tw2sp": ("Taiwan Traditional to Simplified, with idioms", "cn-tw", "cn-s", ["TSPhrases"], [["TWPhrasesRev", *_TW_REV], _TS]),
    "hk2s": ("Hong Kong Traditional to Simplified", "cn-hk", "cn-s", ["TSPhrases"], [_HK_REV, _TS]),
    "hk2sp": ("Hong Kong Traditional to Simplified, with idioms", "cn-hk", "cn-s", ["TSPhrases"], [["HKPhrasesRev", *_HK_REV], _TS]),
    "t2tw": ("Traditional to Taiwan Traditional", "cn-t", "cn-tw", _TW, [_TW]),
    "tw2t": ("Taiwan Traditional to Traditional", "cn-tw", "cn-t", ["TWVariantsRevPhrases"], [_TW_REV]),
    "t2hk": ("Traditional to Hong Kong Traditional", "cn-t", "cn-hk", _HK, [_HK]),
    "hk2t": ("Hong Kong Traditional to Traditional", "cn-hk", "cn-t", ["HKVariantsRevPhrases"], [_HK_REV]),
    "jp2t": ("Japanese new forms to Traditional", "jp-n", "cn-t", ["JPShinjitaiPhrases"], [["JPShinjitaiPhrases", "JPShinjitaiCharacters"]]),
    "t2jp": ("Traditional to Japanese new forms", "cn-t", "jp-n", None, [["JPShinjitaiCharactersRev"]]),
}

REGIONS = {
    "cn-s": "Simplified Chinese",
    "cn-t": "Traditional Chinese",
    "cn-tw": "Traditional Chinese, Taiwan",
    "cn-hk": "Traditional Chinese, Hong Kong",
    "jp-t": "Japanese, old forms",
    "jp-n": "Japanese, new forms",
}

#: (from, to): config. Between mainland and Taiwan or Hong Kong, idioms are converted too.
PAIRS = {
    ("cn-s", "cn-t"): "s2t", ("cn-s", "cn-tw"): "s2twp", ("cn-s", "cn-hk"): "s2hkp", ("cn-t", "cn-s"): "t2s", ("cn-tw", "cn-s"): "tw2sp",
    ("cn-hk", "cn-s"): "hk2sp", ("cn-t", "cn-tw"): "t2tw", ("cn-tw", "cn-t"): "tw2t", ("cn-t", "cn-hk"): "t2hk", ("cn-hk", "cn-t"): "hk2t",
    ("jp-n", "jp-t"): "jp2t", ("jp-t", "jp-n"): "t2jp", ("jp-n", "cn-t"): "jp2t", ("cn-t", "jp-n"): "t2jp",
}


def parse_config(name: str) -> str:
    if name not in CONFIGS:
        raise ValueError(f"unknown config {name!r}; there are {', '.join(CONFIGS)}")
    return name


def parse_region(code: str) -> str:
    if code not in REGIONS:
        raise ValueError(f"unknown region {code!r}; there are {', '.join(REGIONS)}")
    return code


def config_for(source: str, target: str) -> str:
    pair = parse_region(source), parse_region(target)
    if pair not in PAIRS:
        raise ValueError(f"no conversion from {source} to {target}")
    return PAIRS[pair]


#: (detected, target): configs in order; pairs not named, but equal ones, are errors.
ROUTES = {
    ("cn-t", "cn-s"): ["t2s"], ("cn-tw", "cn-s"): ["tw2sp"], ("cn-hk", "cn-s"): ["hk2sp"], ("jp-t", "cn-s"): ["t2s"], ("jp-n", "cn-s"): ["jp2t", "t2s"],
    ("cn-s", "cn-t"): ["s2t"], ("jp-n", "cn-t"): ["jp2t"], ("jp-t", "cn-t"): [],
}


def route(detected: str | None, target: str = "cn-s") -> list[str] | None:
    """The configs to run; none if nothing was detected or it is there already; None if there is no way."""
    parse_region(target)
    if detected is None or detected == target:
        return []
    return ROUTES.get((detected, target))


@dataclass
class Plan:
    segmentation: Group | None
    chain: list[Group]
    model: Ngrams | None = None
    mode: str = "off"

    def convert(self, text: str) -> str:
        return matching.convert(text, self.segmentation, self.chain, self.model, self.mode)

    def translation(self) -> dict[str, str] | None:
        """The character map that the plan equals, if it is one."""
        if self.segmentation or len(self.chain) != 1 or len(self.chain[0].layers) != 1 or self.mode != "off":
            return None
        values = self.chain[0].layers[0].values
        return values if all(len(k) == len(v) == 1 and k >= "\x80" for k, v in values.items()) else None


def reversed_lines(lines) -> list[str]:
    """A dictionary from values to keys, in order of meeting and as often as met; annotations name the key to prefer."""
    out: dict[str, list[str]] = {}
    prefer: dict[str, str] = {}
    for line in lines:
        if line.startswith("# @reverse-prefer:"):
            if words := line.removeprefix("# @reverse-prefer:").split():
                prefer[words[0]] = words[-1]
        elif entry := matching.parse_line(line):
            for value in entry[1]:
                out.setdefault(value, []).append(entry[0])
    for value, first in prefer.items():
        if first in out.get(value, ()):
            out[value].remove(first)
            out[value].insert(0, first)
    return [f"{k}\t{' '.join(v)}" for k, v in sorted(out.items())]


def patched(base, patch) -> list[str]:
    over = {e[0] for line in patch if (e := matching.parse_line(line))}
    return [x for x in base if not ((e := matching.parse_line(x)) and e[0] in over)] + [x for x in patch if matching.parse_line(x)]


def tofu_lines(lines) -> list[str]:
    """Lines below '# @tofu-risk:', without a first value that is the key itself; nothing left is an error."""
    out, lines = [], list(lines)
    for k, above in enumerate(lines):
        if above.startswith("# @tofu-risk:"):
            entry = matching.parse_line(lines[k + 1]) if k + 1 < len(lines) else None
            values = entry[1][1:] if entry and entry[1][0] == entry[0] else entry[1] if entry else []
            if not values:
                raise ValueError(f"a tofu-risk annotation has no entry below it: line {k + 1}")
            out.append(f"{entry[0]}\t{' '.join(values)}")
    return out


def dictionary(registry: Registry, name: str) -> list[str] | tuple[str, ...]:
    """Lines of a source or derived dictionary."""
    if name.endswith("Rev") and name[:-3] in ("TWVariants", "HKVariants", "JPShinjitaiCharacters"):
        return reversed_lines(registry.lines(name[:-3]))
    if name == "TSCharactersExt" and name not in registry.extra:
        return tofu_lines(registry.lines("TSCharacters"))
    if name == _SP and registry.has("STPhrases.patch"):
        return patched(registry.lines(name), registry.lines("STPhrases.patch"))
    if name == _G and name not in registry.extra:
        return projected_lines(registry)
    return registry.lines(name)


def strict_simplification(registry: Registry) -> Plan:
    """Traditional to Simplified with strict priority of dictionaries and without segments, as phrases are projected."""
    return Plan(None, [Group([matching.layer_of(dictionary(registry, n)) for n in _TS])])


def projected_lines(registry: Registry) -> list[str]:
    """Regional phrases by their simplified form; here dictionaries have strict priority and texts no segments."""
    group = strict_simplification(registry).chain[0]
    out: dict[str, str] = {}
    for name in ("HKPhrases", "TWPhrases"):
        for line in registry.lines(name):
            if entry := matching.parse_line(line):
                short = "".join(_walk(group, entry[0]))
                if len(short) >= 3:
                    if out.setdefault(short, entry[0]) != entry[0]:
                        raise ValueError(f"phrases share the form {short}: {out[short]}, {entry[0]}")
    return [f"{k}\t{v}" for k, v in sorted(out.items())]


def _walk(group: Group, text: str):
    at = 0
    for s, e, layer, key in matching.matches(group, text):
        yield text[at:s]
        yield layer.values[key]
        at = e
    yield text[at:]


Custom = list[tuple[str, str]]


def _group(registry: Registry, names: list[str], custom: Custom, priority: str) -> Group:
    found = [dictionary(registry, n) for n in names]
    layers = [matching.layer_of(*found)] if priority == "merged" else [matching.layer_of(x) for x in found]
    if custom:
        first = Layer()
        for key, value in custom:
            first.add(key, [value])
        layers.insert(0, first)
    return Group(layers)


def resolve(config: str, registry: Registry | None = None, custom: Custom | None = None, model: Ngrams | None = None, mode: str = "off", priority: str = "merged") -> Plan:
    """The plan of a named config; a dictionary that is missing is an error by name."""
    _, _, _, segmentation, chain = CONFIGS[parse_config(config)]
    registry, custom = registry or Registry(), custom or []
    seg = _group(registry, segmentation, custom, priority) if segmentation else None
    return Plan(seg, [_group(registry, names, custom, priority) for names in chain], model, mode)


def missing(config: str, registry: Registry | None = None) -> list[str]:
    """Dictionaries that a config needs and no source has."""
    registry, out = registry or Registry(), []
    _, _, _, segmentation, chain = CONFIGS[parse_config(config)]
    for name in dict.fromkeys([*(segmentation or []), *(n for group in chain for n in group)]):
        try:
            dictionary(registry, name)
        except MissingDictionary as e:
            out.append(str(e).split(":")[0].removeprefix("no dictionary "))
    return list(dict.fromkeys(out))


def resolve_json(source: str, registry: Registry | None = None, custom: Custom | None = None, model: Ngrams | None = None, mode: str = "off") -> Plan:
    """The plan of a JSON config: segmentation.dict and conversion_chain[].dict of file, inline or group dictionaries."""
    spec, registry = json.loads(source), registry or Registry()

    def lines_of(node) -> list[str]:
        kind = node.get("type")
        if kind == "inline":
            first = lambda v: (v if isinstance(v, str) else " ".join(v)).split()[:1]
            return [f"{k}\t{value}" for k, v in node["entries"].items() for value in first(v)]
        if kind in ("text", "ocd", "ocd2") and "file" in node:
            name = node["file"]
            for end in (".ocd2", ".ocd", ".txt"):
                name = name.removesuffix(end)
            return list(dictionary(registry, name))
        raise ValueError(f"unknown dictionary type {kind!r}")

    def layers_of(node) -> list[Layer]:
        if node.get("type") != "group":
            return [matching.layer_of(lines_of(node))]
        children = node["dicts"]
        if all(c.get("type") in ("text", "ocd", "ocd2") and "file" in c for c in children):
            return [matching.layer_of(*map(lines_of, children))]
        return [layer for c in children for layer in layers_of(c)]

    def group_of(node) -> Group:
        first = Layer()
        for key, value in custom or []:
            first.add(key, [value])
        return Group([*([first] if custom else []), *layers_of(node)])

    seg = spec.get("segmentation")
    return Plan(group_of(seg["dict"]) if seg else None, [group_of(step["dict"]) for step in spec["conversion_chain"]], model, mode)
