"""The corpus pipeline: documents in, packed sequences out, each stage one of the operators.

Each stage works on all that its predecessor kept, written as Parquet in the
shared folder (spark.checkpoint.dir) and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphflow.llm import exact_dedup, language_id, packing, pii, simhash
from glyphflow.llm.common import dropped, dropped_since, mark, table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID; documents that it rejects go."""
    return language_id.accepted(docs, language_id.fit(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup; of equal texts the least doc_id stays."""
    return exact_dedup.keep_first(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup; of each component the least doc_id stays."""
    return simhash.keep_one(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences along the curve; the pieces carry their ids."""
    return packing.packed(docs)


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", simhash_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained and hashed stages have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage wrote goes as soon as its output is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        since = mark()
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        kept = written(out)
        dropped_since(spark, since, kept)
        if k:
            dropped(docs)
        docs = kept
