"""What the training-data operators share: tables, written intermediates, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.sources.shared import shared_dir, store

#: ASCII white space, as the contracts define it (space, tab to carriage return).
ASCII_SPACE = "[\\x20\\x09-\\x0D]+"

#: Paths of intermediates that are still there, in the order they were written.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage in a way that survives lost executors, and gives a
    deterministic input to steps that would otherwise run twice. The table goes
    when the driver's JVM ends, or earlier by dropped() or dropped_since().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphflow/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = store(spark, path)
    files.deleteOnExit(at)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._glyphflow_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Size of a table made by written(), as its files have it."""
    at, files = store(df.sparkSession, df._glyphflow_path)
    return files.getContentSummary(at).getLength()


def _drop(spark: SparkSession, path: str) -> None:
    at, files = store(spark, path)
    files.delete(at, True)
    files.cancelDeleteOnExit(at)
    _written.remove(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables made by written() that nothing will read again."""
    for df in tables:
        if df._glyphflow_path in _written:
            _drop(df.sparkSession, df._glyphflow_path)


def mark() -> int:
    """A point in the sequence of intermediates, for dropped_since()."""
    return len(_written)


def dropped_since(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Removes all intermediates written after the mark but those to keep."""
    kept = {df._glyphflow_path for df in keep}
    for path in [p for p in _written[since:] if p not in kept]:
        _drop(spark, path)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Bound on the values that a sketch of frequent values names, and so on what is broadcast for them.
TRACKED = 1024
#: The sketches of so many groups of tasks are merged at once.
SKETCH_BUCKETS = 128


def frequent(rows: DataFrame, key: str, tracked: int = TRACKED) -> DataFrame:
    """(item): at most ``tracked`` values of a column, all that are frequent among them.

    A frequent-items sketch (the Misra-Gries family) is gathered map-side,
    merged per bucket of tasks, and then over the buckets.
    """
    sketches = rows.groupBy((F.spark_partition_id() % SKETCH_BUCKETS).alias("bucket")).agg(F.expr(f"approx_top_k_accumulate({key}, {tracked})").alias("sketch"))
    return (
        # Grouped, as a global aggregate would also merge the states of empty partitions, which have no type.
        sketches.groupBy((F.col("bucket") * 0).alias("all"))
        .agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
        .select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("item"))
        .select(F.col("item.item").alias("item"))
    )


def join_once(rows: DataFrame, named: DataFrame, keys: list[str], tracked: int = TRACKED) -> DataFrame:
    """Inner join with a table that has each key once; rows of frequent keys get theirs where they lie.

    However many rows one key has, they aren't shuffled to one task.
    """
    spot = fresh(rows, fresh(named, "spot"))
    rows, named = (x.withColumn(spot, F.xxhash64(*keys)) for x in (rows, named))
    hot = F.broadcast(written(frequent(rows, spot, tracked).toDF(spot)))
    near = rows.join(hot, spot, "left_semi").join(F.broadcast(named.join(hot, spot, "left_semi").drop(spot)), keys)
    return near.unionByName(rows.join(hot, spot, "left_anti").join(named.drop(spot), keys)).drop(spot)


def held_out(doc_id) -> F.Column:
    """crc32(doc_id as text) mod 4 is 2; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2


def _to_roots(move: DataFrame) -> DataFrame:
    """Pointers u to m, all m < u, doubled until no m points on."""
    while True:
        on = move.select(F.col("u").alias("o_u"), F.col("m").alias("o_m"))
        jumped = written(move.join(on, move.m == F.col("o_u"), "left").select("u", F.coalesce("o_m", "m").alias("m"), F.col("o_m").isNotNull().alias("open")))
        dropped(move)
        if jumped.where("open").isEmpty():
            return jumped
        move = written(jumped.select("u", "m"))
        dropped(jumped)


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for each vertex of edges(u, v) that isn't its component's minimum.

    Min-label contraction: in each round every vertex that has a smaller
    neighbour points to its least one, and pointers are doubled until all end
    at local minima. Those remain; no edge joins two of them, so each round at
    least halves the vertices of every component, and rounds and doublings are
    logarithmic in number. Minima are taken map-side, so a hub of any degree
    costs one row per task; joins' skewed sides are split by AQE. Nothing
    reaches the driver but whether edges or open pointers remain.
    """
    left = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    )
    moves: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        move = _to_roots(written(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")))
        moves.append(move)
        a = move.select(F.col("u").alias("a_u"), F.col("m").alias("a_m"))
        b = move.select(F.col("u").alias("b_u"), F.col("m").alias("b_m"))
        moved = (
            left.join(a, left.u == F.col("a_u"), "left")
            .join(b, left.v == F.col("b_u"), "left")
            .select(F.coalesce("a_m", "u").alias("x"), F.coalesce("b_m", "v").alias("y"))
            .where("x <> y")
            .select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
            .distinct()
        )
        following = written(moved)
        dropped(left)
        left = following
    if not moves:
        return written(left.select(F.col("u").alias("vertex"), F.col("v").alias("component")))
    result = moves[-1].select(F.col("u").alias("vertex"), F.col("m").alias("component"))
    for move in reversed(moves[:-1]):
        later = result.select(F.col("vertex").alias("l_v"), F.col("component").alias("l_c"))
        here = move.join(later, move.m == F.col("l_v"), "left").select(
            F.col("u").alias("vertex"), F.coalesce("l_c", "m").alias("component")
        )
        result = here.unionByName(result)
    final = written(result)
    dropped(left, *moves)
    return final
