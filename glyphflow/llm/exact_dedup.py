"""Exact dedup by a heavy-hitter split, with DataFrame and SQL functions alone.

1. Every text gets the SHA-256 of its normalised form; ids and digests are
   written once, so the long texts are read once.
2. A frequent-items sketch (the Misra-Gries family; ``approx_top_k``) is
   gathered map-side, merged per bucket of tasks and then over the buckets. It
   names at most TRACKED candidates, whatever the size of the table.
3. The candidates' exact counts and least ids are aggregated map-side; those
   that really repeat are the winners. Their table is bounded by TRACKED, so it
   is broadcast, and rows of hot groups get their answer where they are.
4. All other digests use ordinary shuffling: an aggregation with map-side
   partials, joined back on the digest.

Defined cases: a null text counts as the empty text; very long texts are hashed
whole; a null doc_id sorts after all others; of rows that repeat the same
doc_id and text one stays (any, as they don't differ in what is read); an empty
table gives an empty result; columns other than the two named are not read, and
keep_first returns them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm.common import ASCII_SPACE, TRACKED, frequent, fresh, written

#: A candidate is split off only if it has so many rows; smaller groups shuffle.
HOT_ROWS = 64


def text_digest(text) -> F.Column:
    """Lowercase hex SHA-256 of the text with each run of ASCII white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ").cast("binary"), 256)


def heavy_digests(digests: DataFrame, key: str = "digest", tracked: int = TRACKED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The verified frequent values of key: (hot_digest, hot_first, hot_rows), at most ``tracked`` rows."""
    candidates = frequent(digests, key, tracked).toDF("hot_digest")
    return (
        digests.join(F.broadcast(candidates), F.col(key) == F.col("hot_digest"))
        .groupBy("hot_digest")
        .agg(F.min("first").alias("hot_first"), F.count("*").alias("hot_rows"))
        .where(F.col("hot_rows") >= hot_rows)
    )


def _first(id_col: str, row_col: str) -> F.Column:
    """Orders a group's rows: a row with an id before one without, then by id, then by row number."""
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(row_col).alias("row"))


def _split(digests: DataFrame, tracked: int, hot_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of digests(digest, first, ...): the hot groups, their rows, and the other rows."""
    hot = written(heavy_digests(digests, tracked=tracked, hot_rows=hot_rows))
    split = digests.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    return hot, split.where("hot_digest is not null"), split.where("hot_digest is null").drop(*hot.columns)


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("digest").alias("hot_digest")).agg(F.min("first").alias("hot_first"), F.count("*").alias("hot_rows"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(
        docs.select(F.col(id_col).alias("doc_id"), F.unhex(text_digest(F.col(text_col))).alias("digest_bytes"), F.monotonically_increasing_id().alias("row"))
    ).select("doc_id", F.lower(F.hex("digest_bytes")).alias("digest"), _first("doc_id", "row").alias("first"))
    _, done, rest = _split(digests, tracked, hot_rows)
    shuffled = rest.join(_groups(rest), F.col("digest") == F.col("hot_digest"))
    columns = ["doc_id", "first", "digest", "hot_first", "hot_rows"]
    return done.select(*columns).unionByName(shuffled.select(*columns)).select(
        "doc_id",
        F.col("hot_first.id").alias("keep_id"),
        F.col("hot_rows").alias("group_size"),
        (F.col("first.row") == F.col("hot_first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with their columns; one row of each text.

    The rows are written once with a number and their digest. Rows of hot groups
    go where they lie, by the broadcast winners; of the others only the numbers
    of rows to drop are joined back, so texts aren't shuffled unless those
    numbers are too many to be broadcast.
    """
    row, digest = fresh(docs, "row"), fresh(docs, "digest")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(digest, F.unhex(text_digest(F.col(text_col)))))
    digests = numbered.select(F.lower(F.hex(digest)).alias("digest"), _first(id_col, row).alias("first"))
    hot, _, rest = _split(digests, tracked, hot_rows)
    groups = _groups(rest).where("hot_rows > 1").select(F.col("hot_digest").alias("g_digest"), F.col("hot_first.row").alias("g_row"))
    gone = rest.join(groups, (F.col("digest") == F.col("g_digest")) & (F.col("first.row") != F.col("g_row"))).select(F.col("first.row").alias("gone_row"))
    # Written, its size is known before the texts are joined with it, so they stay in place if it is small.
    gone = written(gone)
    winners = hot.select(F.unhex("hot_digest").alias("hot_bytes"), F.col("hot_first.row").alias("hot_row"))
    hot_bytes, hot_row, gone_row = fresh(numbered, "hot_bytes"), fresh(numbered, "hot_row"), fresh(numbered, "gone_row")
    winners, gone = winners.toDF(hot_bytes, hot_row), gone.toDF(gone_row)
    left = numbered.join(F.broadcast(winners), numbered[digest] == winners[hot_bytes], "left").where(F.col(hot_row).isNull() | (F.col(hot_row) == F.col(row)))
    return left.join(gone, F.col(row) == F.col(gone_row), "left_anti").select(*docs.columns)
