"""Simplified and Traditional tables from CLDR's public transliteration rules.

Spark's jars carry ICU, and ICU carries CLDR's rules between Simplified and
Traditional Chinese: some thousand characters and phrases, each with the
direction in which it holds. They are read from the jar, so that the pipelines
between the two scripts work where no dictionaries are given. They stand in for
those, and don't equal them: Registry uses them only if it is told to.
"""

from __future__ import annotations

import functools
import os
import re
import zipfile
from pathlib import Path

import pyspark

#: The dictionaries that the rules stand in for.
NAMES = ("STCharacters", "STPhrases", "TSCharacters", "TSPhrases")
_RESOURCE = "com/ibm/icu/impl/data/icudata/translit/root.res"
#: A phrase whose rule no other set of rules has; by it the rules are found among all others.
_LANDMARK = "↔一見鍾情;"
_SET = re.compile(r"\$(\w+)\s*=\s*\[([^\]]*)\]")
_RULE = re.compile(r"(?:\$(?P<before>\w+)\s*\{\s*)?(?P<left>[^\s↔→←{}]+)(?:\s*\}\s*(?P<after>[^\s↔→←{}$\[]+))?\s*(?P<way>[↔→←])\s*(?P<right>[^\s↔→←{}]+)")


def _rules() -> str | None:
    home = os.environ.get("SPARK_HOME") or str(Path(pyspark.__file__).parent)
    for jar in sorted(Path(home, "jars").glob("icu4j-*.jar")):
        with zipfile.ZipFile(jar) as archive:
            text = archive.read(_RESOURCE).decode("utf-16-be", "replace")
        at = text.find(_LANDMARK)
        if at >= 0:
            return text[text.rfind("\0", 0, at) + 1 : text.find("\0", at)]
    return None


@functools.cache
def tables() -> dict[str, tuple[str, ...]]:
    """Lines (key, tab, values) of the four dictionaries; none where there is no such jar."""
    text = _rules()
    if text is None:
        return {}
    sets: dict[str, str] = {}
    to_traditional: dict[str, list[str]] = {}
    to_simplified: dict[str, list[str]] = {}
    in_context: list[tuple[str, str, str, str]] = []
    for rule in text.split(";"):
        if found := _SET.search(rule):
            sets[found[1]] = found[2]
        elif found := _RULE.fullmatch(rule.strip()):
            left, right, way = found["left"], found["right"], found["way"]
            if found["before"] or found["after"]:
                if way == "→":
                    in_context.append((found["before"] or "", left, found["after"] or "", right))
                continue
            if way in "↔→":
                to_traditional.setdefault(left, []).append(right)
            if way in "↔←":
                to_simplified.setdefault(right, []).append(left)
    # A traditional character that only comes back to a simplified one is its further candidate.
    for key, values in to_simplified.items():
        if key not in to_traditional.get(values[0], [key]):
            to_traditional[values[0]].append(key)
    # What holds between neighbours becomes phrases with those neighbours.
    for before, left, after, right in in_context:
        for c in sets.get(before, "") or [""]:
            first = lambda x: "".join(to_traditional.get(y, [y])[0] for y in x)
            to_traditional.setdefault(c + left + after, []).insert(0, first(c) + right + first(after))
    out = {}
    for one, many, entries in (("STCharacters", "STPhrases", to_traditional), ("TSCharacters", "TSPhrases", to_simplified)):
        for name, single in ((one, True), (many, False)):
            out[name] = tuple(f"{k}\t{' '.join(dict.fromkeys(v))}" for k, v in sorted(entries.items()) if (len(k) == 1) is single)
    return out
