"""Dictionary lines as a table, and the registry of dictionaries by name.

A dictionary comes from, in this order: a registered list of lines, a folder of
``<name>.txt`` files (a parameter; by default what the environment variable
GLYPHFLOW_DICTIONARIES names), the small tables that the package states, and,
only if asked for, the tables that public transliteration rules give (see
sources.cldr). A name found nowhere raises MissingDictionary; nothing is ever
made up for it.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from glyphflow.sources import cldr
from glyphflow.sources.fixed_tables import FIXED

LINE_SCHEMA = "dict string, line_no int, line string"
#: What conversions draw on; the last five are derived (see operators.dictionary_etl).
SOURCES = (
    "STCharacters", "STPhrases", "TSCharacters", "TSPhrases", "TWPhrases", "TWPhrasesRev", "TWVariants", "TWVariantsPhrases", "TWVariantsRevPhrases",
    "HKPhrases", "HKPhrasesRev", "HKVariants", "HKVariantsPhrases", "HKVariantsRevPhrases", "JPShinjitaiCharacters", "JPShinjitaiPhrases",
    "CJK_Compatibility_Ideographs",
)
DERIVED = ("TSCharactersExt", "TWVariantsRev", "HKVariantsRev", "JPShinjitaiCharactersRev", "STPhrases_GeneratedFromRegionalPhrases")


class MissingDictionary(LookupError):
    """A dictionary that no source has."""


def default_root() -> str | None:
    return os.environ.get("GLYPHFLOW_DICTIONARIES") or None


class Registry:
    """Lines of dictionaries by name."""

    def __init__(self, root: str | None = None, extra: dict[str, list[str]] | None = None, stand_ins: bool = False):
        self.root, self.extra, self.stand_ins = root or default_root(), {k: tuple(v) for k, v in (extra or {}).items()}, stand_ins

    @classmethod
    def of_store(cls, spark: SparkSession, folder: str, extra: dict[str, list[str]] | None = None, stand_ins: bool = False) -> Registry:
        """A registry of a folder of <name>.txt files in any store that Spark reads."""
        rows = spark.read.text(f"{folder.rstrip('/')}/*.txt", wholetext=True).select("_metadata.file_name", "value").collect()
        found = {r["file_name"].removesuffix(".txt"): r["value"].split("\n") for r in rows}
        return cls(extra=found | (extra or {}), stand_ins=stand_ins)

    def lines(self, name: str) -> tuple[str, ...]:
        if name in self.extra:
            return self.extra[name]
        if self.root and (path := Path(self.root, f"{name}.txt")).exists():
            return tuple(path.read_text(encoding="utf-8").split("\n"))
        if name in FIXED:
            return tuple(FIXED[name].strip("\n").split("\n"))
        if self.stand_ins and name in cldr.tables():
            return cldr.tables()[name]
        raise MissingDictionary(f"no dictionary {name}: give a folder that has {name}.txt, or register its lines")

    def has(self, name: str) -> bool:
        try:
            self.lines(name)
        except MissingDictionary:
            return False
        return True

    def names(self) -> list[str]:
        return [n for n in (*SOURCES, "STPhrases.patch") if self.has(n)]

    def table(self, spark: SparkSession, *names: str) -> DataFrame:
        """(dict, line_no, line) of the named dictionaries, or of all there are."""
        rows = [(n, k, line) for n in names or self.names() for k, line in enumerate(self.lines(n), 1)]
        return spark.createDataFrame(rows, LINE_SCHEMA)


def read_lines(spark: SparkSession, name: str, *paths: str) -> DataFrame:
    """Dictionary files from any store that Spark reads, numbered in order of files and lines."""
    out = None
    for k, path in enumerate(paths):
        whole = spark.read.text(path, wholetext=True)
        part = whole.selectExpr("posexplode(split(value, '\\n')) as (n, line)").selectExpr(f"'{name}' as dict", f"{k} * 100000000 + n + 1 as line_no", "line")
        out = part if out is None else out.unionByName(part)
    return out
