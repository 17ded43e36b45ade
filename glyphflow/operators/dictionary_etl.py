"""Dictionaries as DataFrame jobs: parse, overlay, merge, reverse, derive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entries(lines: DataFrame) -> DataFrame:
    """(dict, ord, key, values) of every line that is an entry, keys that repeat among them.

    Comments, blank lines, lines without a tab and keys without a value are skipped.
    """
    line = F.regexp_replace("line", "\\r", "")
    parts = F.split(line, "\t", 2)
    rows = lines.select("dict", F.col("line_no").alias("ord"), line.alias("line"), parts[0].alias("key"), F.split(F.trim(F.regexp_replace(parts[1], "\\s+", " ")), " ").alias("values"))
    return rows.where(~F.col("line").startswith("#") & (F.trim("line") != "") & F.col("line").contains("\t") & (F.col("values")[0] != "")).drop("line")


def parse(lines: DataFrame) -> DataFrame:
    """The entries, of a key that repeats the last one."""
    return entries(lines).groupBy("dict", "key").agg(F.max("ord").alias("ord"), F.max_by("values", "ord").alias("values")).select("dict", "ord", "key", "values")


def first_values(parsed: DataFrame) -> DataFrame:
    """(dict, ord, key, value): only the first candidate."""
    return parsed.select("dict", "ord", "key", F.col("values")[0].alias("value"))


def from_entries(pairs: DataFrame) -> DataFrame:
    """Single-valued entries from (ord, key, value); the last of a key counts."""
    return pairs.groupBy("key").agg(F.max("ord").alias("ord"), F.array(F.max_by("value", "ord")).alias("values"))


def overlay(base: DataFrame, patch: DataFrame) -> DataFrame:
    """Patched keys leave the base; all patch rows follow it, their values replacing, not extending."""
    after = base.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("last"))
    moved = patch.crossJoin(F.broadcast(after)).select("dict", (F.col("ord") + F.col("last")).alias("ord"), "key", "values")
    return base.join(patch.select("key"), "key", "left_anti").select("dict", "ord", "key", "values").unionByName(moved)


def merge(parsed: DataFrame, order: list[str]) -> DataFrame:
    """One dictionary of several: (key, value, candidates, dict).

    The union, in which the last dictionary named wins a key. Candidates stay
    those of the last row that has several, even if a later row has one value.
    """
    rank = F.create_map(*[x for k, n in enumerate(order) for x in (F.lit(n), F.lit(k))])[F.col("dict")]
    rows = parsed.where(F.col("dict").isin(*order)).withColumn("at", F.struct(rank.alias("rank"), F.col("ord")))
    several = F.when(F.size("values") > 1, F.col("at"))
    return rows.groupBy("key").agg(
        F.max_by(F.col("values")[0], "at").alias("value"),
        F.coalesce(F.max_by(F.when(F.size("values") > 1, F.col("values")), several), F.max_by("values", "at")).alias("candidates"),
        F.max_by("dict", "at").alias("dict"),
    )


def preferences(lines: DataFrame) -> DataFrame:
    """(key, prefer) of the annotations '# @reverse-prefer: key [prefer]'; of several words the last is preferred."""
    words = F.split(F.trim(F.regexp_replace(F.expr("substr(line, length('# @reverse-prefer:') + 1)"), "\\s+", " ")), " ")
    rows = lines.where(F.col("line").startswith("# @reverse-prefer:")).select("line_no", words[0].alias("key"), F.element_at(words, -1).alias("prefer")).where("key <> ''")
    return rows.groupBy("key").agg(F.max_by("prefer", "line_no").alias("prefer"))


def reverse(rows: DataFrame, prefer: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """(key, values): every value as a key, with the keys that had it in order of meeting and as often as met; a preferred one first.

    A preference that no mapping matches is passed over, or an error if strict.
    """
    each = rows.select("ord", "key", F.posexplode("values").alias("pos", "value"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("ord", "pos", "key"))), lambda x: x["key"])
    out = each.groupBy(F.col("value").alias("key")).agg(keys.alias("values"))
    if prefer is None:
        return out
    at = F.array_position("values", F.col("prefer"))
    before, after = F.slice("values", F.lit(1), at.cast("int") - 1), F.slice("values", at.cast("int") + 1, F.size("values"))
    first = F.when(F.coalesce(at, F.lit(0)) > 0, F.concat(F.array("prefer"), before, after)).otherwise(F.col("values"))
    if strict:
        lacking = F.concat(F.lit("no mapping for the preference "), F.col("key"), F.lit(" "), F.col("prefer"))
        first = F.when(F.col("prefer").isNotNull() & (F.coalesce(at, F.lit(0)) == 0), F.raise_error(lacking).cast("array<string>")).otherwise(first)
        return out.join(prefer, "key", "full").select("key", first.alias("values"))
    return out.join(F.broadcast(prefer), "key", "left").select("key", first.alias("values"))


def tofu_risk(lines: DataFrame) -> DataFrame:
    """(key, values) of the lines below '# @tofu-risk:' annotations, without a first value that is the key itself; nothing left is an error."""
    below = Window.partitionBy("dict").orderBy("line_no")
    rows = lines.withColumn("next", F.lead("line").over(below)).where(F.col("line").startswith("# @tofu-risk:"))
    parts = F.split("next", "\t", 2)
    found = F.split(F.trim(F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\\s+", " ")), " ")
    found = F.filter(found, lambda v: v != "")
    values = F.when(F.get(found, F.lit(0)) == parts[0], F.slice(found, 2, 1 << 20)).otherwise(found)
    bad = F.col("next").isNull() | F.col("next").startswith("#") | (F.coalesce(F.size(values), F.lit(0)) <= 0)
    key = F.when(bad, F.raise_error(F.concat(F.lit("a tofu-risk annotation has no entry below it: line "), F.col("line_no").cast("string")))).otherwise(parts[0])
    return rows.select(key.alias("key"), values.alias("values"))


def project_phrases(phrases: DataFrame, to_simplified, least: int = 3) -> DataFrame:
    """(key, value): phrases by their simplified form, of at least so many characters.

    to_simplified is a Column function; two phrases that meet in one form are an error.
    """
    rows = phrases.select(to_simplified(F.col("key")).alias("short"), "key").where(F.char_length("short") >= least)
    grouped = rows.groupBy("short").agg(F.min("key").alias("value"), F.count_distinct("key").alias("n"))
    value = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("phrases share the form "), F.col("short")))).otherwise(F.col("value"))
    return grouped.select(F.col("short").alias("key"), value.alias("value")).orderBy("key")


def sort_entries(parsed: DataFrame) -> DataFrame:
    return parsed.orderBy("dict", "key")


def sorted_lines(lines: DataFrame) -> DataFrame:
    """(dict, line_no, line): dictionaries as text, sorted by key.

    Comments and blank lines stay above the entry that followed them; what
    stands above the last blank line before the first entry stays at the top,
    and what follows the last entry at the end.
    """
    plain = F.regexp_replace("line", "\\r", "")
    is_entry = ~plain.startswith("#") & (F.trim(plain) != "") & plain.contains("\t")
    whole, below = Window.partitionBy("dict"), Window.partitionBy("dict").orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    rows = lines.select("dict", "line_no", plain.alias("line"), is_entry.alias("is_entry"))
    owner = F.struct("line_no", F.split("line", "\t", 2)[0].alias("key"))
    rows = rows.withColumn("owner", F.first(F.when(F.col("is_entry"), owner), ignorenulls=True).over(below))
    rows = rows.withColumn("first", F.min(F.when(F.col("is_entry"), F.col("line_no"))).over(whole))
    blank = F.max(F.when((F.trim("line") == "") & (F.col("line_no") < F.col("first")), F.col("line_no"))).over(whole)
    rows = rows.withColumn("part", F.when(F.col("owner").isNull(), 2).when(F.col("line_no") <= F.coalesce(blank, F.lit(0)), 0).otherwise(1))
    order = Window.partitionBy("dict").orderBy("part", F.when(F.col("part") == 1, F.col("owner.key")), F.when(F.col("part") == 1, F.col("owner.line_no")), "line_no")
    return rows.select("dict", F.row_number().over(order).alias("line_no"), "line")


def rank() -> Column:
    """An entry's place in its dictionary sorted by key."""
    return F.row_number().over(Window.partitionBy("dict").orderBy("key"))


def find_targets(parsed: DataFrame, keyword: str | Column) -> DataFrame:
    """Entries with a value that contains the keyword."""
    word = F.lit(keyword) if isinstance(keyword, str) else keyword
    return parsed.where(F.exists("values", lambda v: v.contains(word)))


def lines_of(parsed: DataFrame) -> DataFrame:
    """Entries as dictionary lines again."""
    return parsed.select("dict", "ord", F.concat_ws("\t", "key", F.array_join("values", " ")).alias("line"))
