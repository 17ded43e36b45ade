"""Texts from files, and results to files, through Spark's readers and writers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions.detection import detect_bytes
from glyphflow.sources.shared import shared_dir, store


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """One text that the caller has, such as standard input, as (path, text)."""
    return spark.createDataFrame([("-", text)], "path string, text string")


def local_files(path: str) -> list[str]:
    """Regular files of a folder of the local file system, at any depth, in order of path; links are skipped."""
    out = []
    for at, folders, names in os.walk(path):
        folders[:] = sorted(f for f in folders if not os.path.islink(os.path.join(at, f)))
        out += [p for n in names if not os.path.islink(p := os.path.join(at, n)) and os.path.isfile(p)]
    return sorted(out)


def read_bytes(spark: SparkSession, *paths: str, recursive: bool = True, glob: str | None = None, lenient: bool = False) -> DataFrame:
    """(path, content) of files and folders; lenient logs files that can't be read and goes on."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if lenient:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    found: list[str] = []
    for path in paths:
        plain = qualified(spark, path)[0].removeprefix("file:")
        folder = recursive and plain.startswith("/") and os.path.isdir(plain)
        # Other stores have no links; a local folder is listed here, so that links can be told.
        found += local_files(plain) if folder else [path]
    if not found:
        return spark.createDataFrame([], "path string, content binary")
    return reader.load(found).select("path", "content")


def read_texts(spark: SparkSession, *paths: str, recursive: bool = True, strict: bool = True) -> DataFrame:
    """(path, text) of whole files; a file that isn't UTF-8 is an error, or null if not strict."""
    text = F.col("content").cast("string")
    bad = F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string") if strict else F.lit(None)
    return read_bytes(spark, *paths, recursive=recursive).select("path", F.when(F.is_valid_utf8(text), text).otherwise(bad).alias("text"))


def qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The path as Spark's readers name it, and whether there is such a file or folder."""
    at, files = store(spark, path)
    return files.makeQualified(at).toString(), files.exists(at)


def in_order(found: DataFrame, paths: list[str]) -> DataFrame:
    """The files with place, the number of the given path that each is or lies under, and shown, the path in its terms.

    A file under several of the paths comes once for each. Folders' files
    follow in order of path.
    """
    spark = found.sparkSession
    given = spark.createDataFrame([(k, qualified(spark, p)[0], p.rstrip("/")) for k, p in enumerate(paths)], "place int, above string, given string")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    placed = found.withColumn("above", F.explode(above)).join(F.broadcast(given), "above")
    return placed.withColumn("shown", F.concat("given", F.expr("substr(path, length(above) + 1)"))).drop("above", "given")


def listed_paths(spark: SparkSession, path: str, null_separated: bool = False) -> list[str]:
    """Paths named in a file, one per line or separated by NUL; blanks are dropped."""
    rows = spark.read.option("lineSep", "\0" if null_separated else "\n").text(path).select(F.trim("value").alias("p")).where("p <> ''")
    return [r["p"] for r in rows.collect()]


def write_lines(df: DataFrame, text: Column | str, path: str) -> None:
    """Each text as lines of text files; writers end every text with a line feed."""
    df.select(F.col(text) if isinstance(text, str) else text).write.mode("errorifexists").text(path)


def write_in_place(df: DataFrame, path_col: str = "path", text_col: str = "text") -> int:
    """Overwrites each file with its text, after all texts were computed and written elsewhere; how many files.

    Files are written one by one by the driver's file system client, a partition
    of texts at a time, so this is for sets of files, not for corpora.
    """
    spark, n = df.sparkSession, 0
    spool = f"{shared_dir(spark)}/glyphflow/{uuid.uuid4().hex}"
    df.select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).write.parquet(spool)
    for row in spark.read.schema("path string, text string").parquet(spool).toLocalIterator():
        at, files = store(spark, row["path"])
        out = files.create(at, True)
        out.write(bytearray(row["text"].encode()))
        out.close()
        n += 1
    at, files = store(spark, spool)
    files.delete(at, True)
    return n


def detections(files: DataFrame, registry=None) -> DataFrame:
    """Of (path, content): region, confidence, path; unknown and 0 where nothing is detected."""
    found = files.select("path", detect_bytes("content", registry).alias("d"))
    return found.select(F.coalesce("d.region", F.lit("unknown")).alias("region"), F.coalesce("d.confidence", F.lit(0)).alias("confidence"), "path")


def write_detections(found: DataFrame, path: str) -> None:
    found.select("region", "confidence", "path").write.option("sep", "\t").csv(path)
