"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

1. One pass of Arrow batches over the whole texts writes (doc_id, fingerprint).
   Equal fingerprints collapse to one vertex, their least doc_id, by an
   aggregation with map-side partials.
2. Candidates meet in tiles. Fingerprints within the radius r agree on all but
   r of any r + 2 blocks of bits, so each is sent, for every choice of 2 of the
   4 blocks, to the tile of those blocks' bits (exact for radius 2 or less).
   Tiles of more than TILE fingerprints are dealt anew by blocks of the bits
   that are still free, which bounds a tile by its free bits: 2**32, 2**16,
   2**8. No pair is lost, no group is held whole by a task or sent all-to-all.
3. Within a tile, numpy compares squares of sub-tiles sorted by population
   count: exclusive-or and bit counts, skipping squares whose population counts
   differ by more than the radius. A tile returns a spanning forest, not pairs.
4. Components of the forests' edges: see common.connected_components. Rows of
   frequent fingerprints get their component by broadcast, all others by a join.

Defined cases: a null text is the empty text; texts without words have
fingerprint zero and link like any other; texts of fewer words than a shingle
hash as one sequence; very long texts are hashed block by block; a null doc_id is
ignored as a component's minimum; doc_id is read as a 64-bit integer below
2**62; rows repeat as they come; an empty table gives an empty result; other
columns aren't read, and keep_one returns them as they are.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import connected_components, dropped_since, fresh, join_once, mark, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a tile; larger ones are split by further bits.
TILE = 1024
_SUB = 256
#: Vertices from here on stand for fingerprints of which no row has an id.
_NO_ID = 1 << 62
_BLOCK = 1 << 15
_WORDS = re.compile("[^\x20\x09-\x0d]+")
_UPPER = {i: i + 32 for i in range(65, 91)}


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; zero for a text without words."""
    words = _WORDS.findall((text or "").translate(_UPPER))
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(" ".join(words), SEED)
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    hashed = xxhash.xxh64_digest
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + shingle - 1]
        grams = map(" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        bits = np.frombuffer(b"".join([hashed(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and its fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def hashed(batches):
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(hashed, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("fp", "long"))


def tile_forest(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct fingerprints the position of its component's first member in the tile."""
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    f = fps[order]
    pop = np.bitwise_count(f).astype(np.int16)
    label = np.arange(len(f))
    for i in range(0, len(f), _SUB):
        for j in range(i, len(f), _SUB):
            if pop[j] - pop[min(i + _SUB, len(f)) - 1] > radius:
                break  # sorted by population count: all further squares differ by more
            a, b = np.nonzero(np.bitwise_count(f[i : i + _SUB, None] ^ f[None, j : j + _SUB]) <= radius)
            a, b = a + i, b + j
            while len(a):
                x, y = label[a], label[b]
                if (open_ := x != y).any():
                    a, b, low = a[open_], b[open_], np.minimum(x, y)[open_]
                    np.minimum.at(label, x[open_], low)
                    np.minimum.at(label, y[open_], low)
                    while (label != label[label]).any():
                        label = label[label]
                else:
                    break
    out = np.empty(len(f), int)
    out[order] = order[label]
    return out


_FOUND = ["u", "v", "fp", "vertex", "mask"]


def _forests(batches, radius: int, most: int | None):
    """Over rows sorted by (tile, fp, vertex): edges (u, v) of each tile's spanning forest, or, of a tile of more than most rows, the rows themselves (fp, vertex, mask)."""

    def edges(rows):
        root = rows["vertex"][tile_forest(rows["fp"].view(np.uint64), radius)]
        keep = root != rows["vertex"]
        u, v = np.maximum(rows["vertex"], root)[keep], np.minimum(rows["vertex"], root)[keep]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *[pa.nulls(len(u), pa.int64())] * 3], _FOUND)

    def left(rows):
        n = len(rows["fp"])
        return pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 2, *(pa.array(rows[c]) for c in ("fp", "vertex", "mask"))], _FOUND)

    names = ("tile", "fp", "vertex", "mask")
    tail, large = {c: np.zeros(0, np.int64) for c in names}, None  # the run that may go on, and the tile whose rows are passed on
    for batch in batches:
        rows = {c: np.concatenate([tail[c], np.asarray(batch[c])]) for c in names}
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows["tile"])) + 1])
        ends = np.concatenate([starts[1:], [len(rows["tile"])]])
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            run, last = {c: rows[c][s:e] for c in names}, e == len(rows["tile"])
            if e > s and run["tile"][0] == large or most is not None and e - s > most:
                large, run = run["tile"][0], left(run)
                yield run
                tail = {c: rows[c][:0] for c in names}
            elif last:
                tail = run
            elif e - s > 1:
                yield edges(run)
    if len(tail["fp"]) > 1:
        yield edges(tail)


def _choices(level: int) -> dict[int, list[int]]:
    """For each mask that tiles of the level before have: the masks that fix 2 more of its 4 free blocks."""
    masks, out = [0], {}
    for bits in (16, 8, 4)[: level + 1]:
        out = {}
        for mask in masks:
            free = [b for b in range(64) if not mask >> b & 1]
            blocks = [sum(1 << b for b in free[i : i + bits]) for i in range(0, len(free), bits)]
            out[mask] = [mask | x | y for x, y in combinations(blocks, 2)]
        masks = sorted({x for xs in out.values() for x in xs})
    return out


def _signed(x: int) -> F.Column:
    return F.lit(x - (1 << 64) if x >> 63 else x)


def _deal(rows: DataFrame, level: int) -> DataFrame:
    """Each row once for every choice of 2 of the 4 blocks of bits that are still free.

    mask has the bits on which a tile's fingerprints agree.
    """
    options = {mask: F.array(*map(_signed, more)) for mask, more in _choices(level).items()}
    if level:
        options = F.create_map(*[x for mask, more in options.items() for x in (_signed(mask), more)])[F.col("mask")]
    else:
        options = options[0]
    dealt = rows.select("fp", "vertex", F.explode(options).alias("mask"))
    return dealt.withColumn("tile", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))


def links(vertices: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges u, v that join the vertices (fp distinct, vertex) exactly as all links within the radius do.

    Each level deals its rows once; the task that meets a tile too large for it
    passes the tile's rows on to the next level as they come.
    """
    if radius > 2:
        raise ValueError("blocks are dealt for a radius of at most 2")
    edges, rest = None, vertices.withColumn("mask", F.lit(0).cast("long"))
    for level in range(3):
        dealt = _deal(rest, level).repartition("tile").sortWithinPartitions("tile", "fp", "vertex")
        most = tile if level < 2 else None
        found = written(dealt.mapInArrow(lambda batches, most=most: _forests(batches, radius, most), ", ".join(f"{c} long" for c in _FOUND)))
        here = found.where("u is not null").select("u", "v")
        edges = here if edges is None else edges.unionByName(here)
        rest = found.where("fp is not null").select("fp", "vertex", "mask")
        if rest.isEmpty():
            break
    return edges


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    fps = written(fingerprints(docs, id_col, text_col))
    vertices = written(fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("vertex")))
    # Only vertices with an id can be a minimum, so an id stands in where there is none.
    known = vertices.select("fp", F.coalesce("vertex", F.lit(_NO_ID) + F.pmod(F.col("fp"), F.lit(_NO_ID))).alias("vertex"))
    since = mark()
    components = connected_components(links(known, radius, tile))
    dropped_since(docs.sparkSession, since, components)
    named = known.join(components, "vertex", "left").select("fp", F.coalesce("component", "vertex").alias("c"))
    return join_once(fps, named, ["fp"]).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("c") < _NO_ID, F.col("c")).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, without those that a smaller doc_id of their component stands for.

    A row without an id is never dropped.
    """
    found, name = near_dedup(docs, id_col, text_col), fresh(docs, "gone")
    # Written, its size is known before the texts are joined with it, so they stay in place if it is small.
    gone = written(found.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
