"""Prefix matching, segmentation and staged conversion of one text.

These are what an Arrow batch runs per row; functions.conversion is the Column
surface. A group is a list of layers; the first layer with any prefix of the
text wins, and within it the longest key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Layer:
    """One dictionary: default values and, per key, all candidates."""

    values: dict[str, str] = field(default_factory=dict)
    candidates: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def add(self, key: str, values) -> None:
        if not key:
            return
        self.values[key] = values[0]
        # One value doesn't displace candidates that an earlier row of the key brought.
        if len(values) > 1 or key not in self.candidates:
            self.candidates[key] = tuple(values)
        if len(values) == 1 and len(self.candidates[key]) == 1:
            self.candidates[key] = tuple(values)


def parse_line(line: str) -> tuple[str, list[str]] | None:
    line = line.replace("\r", "")
    if not line.strip() or line.startswith("#") or "\t" not in line:
        return None
    key, rest = line.split("\t", 1)
    values = rest.split()
    return (key, values) if values else None


def layer_of(*dictionaries) -> Layer:
    """Dictionaries (iterables of lines) merged in order."""
    out = Layer()
    for lines in dictionaries:
        for line in lines:
            if entry := parse_line(line):
                out.add(*entry)
    return out


class Group:
    """Layers in order of priority, indexed for matching."""

    def __init__(self, layers: list[Layer]):
        self.layers = layers
        self._lengths: dict[str, list[tuple[int, ...]]] = {}
        for k, layer in enumerate(layers):
            for key in layer.values:
                self._lengths.setdefault(key[0], [() for _ in layers])
            sizes: dict[str, set[int]] = {}
            for key in layer.values:
                sizes.setdefault(key[0], set()).add(len(key))
            for first, found in sizes.items():
                self._lengths[first][k] = tuple(sorted(found, reverse=True))
        self.starts = self._starting(self._lengths)
        self.starts_beyond_ascii = self._starting(c for c in self._lengths if c >= "\x80")

    @staticmethod
    def _starting(chars) -> re.Pattern | None:
        chars = "".join(sorted(chars))
        return re.compile("[" + re.escape(chars) + "]") if chars else None

    def match(self, text: str, at: int) -> tuple[int, Layer, str] | None:
        """(length, layer, key) of the match at a position."""
        sizes = self._lengths.get(text[at])
        if sizes:
            for layer, lengths in zip(self.layers, sizes, strict=True):
                for n in lengths:
                    key = text[at : at + n]
                    if key in layer.values:
                        return n, layer, key
        return None


def longest_prefix(layer: Layer, text: str) -> tuple[int, str] | None:
    """Bytes matched and the default value."""
    return group_longest_prefix([layer], text)


def longest_prefix_multi(layer: Layer, text: str) -> tuple[int, list[str]] | None:
    return group_longest_prefix_multi([layer], text)


def group_longest_prefix(layers: list[Layer], text: str) -> tuple[int, str] | None:
    m = Group(layers).match(text, 0) if text else None
    return (len(m[2].encode()), m[1].values[m[2]]) if m else None


def group_longest_prefix_multi(layers: list[Layer], text: str) -> tuple[int, list[str]] | None:
    m = Group(layers).match(text, 0) if text else None
    return (len(m[2].encode()), list(m[1].candidates[m[2]])) if m else None


def matches(group: Group, text: str, skip_ascii: bool = False) -> Iterator[tuple[int, int, Layer, str]]:
    """(start, end, layer, key) of the leftmost matches; others' characters are passed over."""
    starts = group.starts_beyond_ascii if skip_ascii else group.starts
    at = 0
    while starts and (m := starts.search(text, at)):
        at = m.start()
        hit = group.match(text, at)
        if hit:
            yield at, at + hit[0], hit[1], hit[2]
            at += hit[0]
        else:
            at += 1


def segments(group: Group, text: str) -> list[tuple[str, bool]]:
    """(segment, whether it matched): matches and the runs between them; they concatenate to the text."""
    out, at = [], 0
    for s, e, _, key in matches(group, text):
        if s > at:
            out.append((text[at:s], False))
        out.append((key, True))
        at = e
    if at < len(text):
        out.append((text[at:], False))
    return out


def stage(group: Group, text: str) -> str:
    """One stage: matches replaced by default values; in a text that begins with ASCII, ASCII is never looked up."""
    out, at = [], 0
    for s, e, layer, key in matches(group, text, skip_ascii=text[:1] < "\x80"):
        out += [text[at:s], layer.values[key]]
        at = e
    return "".join([*out, text[at:]]) if out else text


@dataclass
class Ngrams:
    """Log-probabilities of word tuples, by order."""

    orders: dict[int, dict[tuple[str, ...], float]] = field(default_factory=lambda: {1: {}, 2: {}, 3: {}})

    def pick(self, before: str, candidates: list[str]) -> str | None:
        """The candidate likeliest after what comes before; the earlier of equals."""
        if len(candidates) < 2:
            return candidates[0] if candidates else None
        best, most = candidates[0], float("-inf")
        for c in candidates:
            if (p := self.orders[2].get((before or "<s>", c), float("-inf"))) > most:
                best, most = c, p
        return best


def first_characters(candidates) -> list[str]:
    """Distinct first characters, four at most, in order."""
    return list(dict.fromkeys(c[:1] for c in candidates if c))[:4]


#: Bytes of context by mode; contexts are cut back to whole characters.
CONTEXT = {"bigram": 3, "trigram": 6}


def context_of(text: str, mode: str) -> str:
    return text[-6:].encode()[-CONTEXT[mode] :].decode("utf-8", "ignore")


def stage_ngram(group: Group, text: str, before: str, previous: str, model: Ngrams, mode: str) -> str:
    """One stage in which the model picks among candidates by what was put out before (its last characters; else by previous)."""
    out: list[str] = []
    at, tail = 0, before[-6:]
    for s, e, layer, key in matches(group, text):
        out.append(text[at:s])
        tail = (tail + text[max(at, s - 6) : s])[-6:]
        candidates = layer.candidates[key]
        chosen = candidates[0]
        if len(candidates) > 1 and (tail or previous) and len(firsts := first_characters(candidates)) > 1:
            context = context_of(tail, mode) if tail else previous[-1:] if mode == "bigram" else previous[-2:]
            first = model.pick(context, firsts)
            chosen = first + next(c for c in candidates if c.startswith(first))[1:]
        out.append(chosen)
        at, tail = e, (tail + chosen)[-6:]
    return "".join([*out, text[at:]])


def convert(text: str, segmentation: Group | None, chain: list[Group], model: Ngrams | None = None, mode: str = "off") -> str:
    """Each segment through all stages, on its own; no match crosses a segment."""
    parts = [s for s, _ in segments(segmentation, text)] if segmentation else [text] if text else []
    done: list[str] = []
    tail = ""
    for part in parts:
        previous = ""
        for group in chain:
            if model is None or mode == "off":
                part = stage(group, part)
            else:
                converted = stage_ngram(group, part, tail, previous, model, mode)
                previous, part = converted[-2:], converted
        done.append(part)
        tail = (tail + part)[-6:]
    return "".join(done)
