"""Embedding near-dedup by cover trees and their dual traversal.

1. Vectors that can't link (null, zero, non-finite, null label) are set apart.
   Equal vectors of a label collapse to their least vec_id with a weight, by an
   aggregation with map-side partials on the digest of their bytes, so a group
   of copies costs one point. Vectors move as packed bytes of their own type.
2. A label of more than BLOCK points is dealt to cells: the top of a cover tree
   over a bounded sample of it gives centres (CENTRES in all, so their
   broadcast has a proven bound), each point goes to the nearest, and cells of
   more than BLOCK points are cut by hash. Centres and covering radii then
   decide where a point is shipped: to a cell's blocks only if it may have a
   partner there, by the radius and by the bisector of the two centres.
3. Each pair of blocks is one unit of work. A unit builds a cover tree per
   block, nested nets whose radii halve, and descends both together: node pairs
   too far apart are pruned, node pairs that lie wholly within the threshold
   are taken whole, and what is left is compared by cosine in double precision.
   The links are exactly the pairs at or above the threshold.
4. A unit returns each point's number of links (weighted) and a spanning
   forest, not pairs; counts are summed, forests joined to components. Rows of
   frequent vectors get their result by broadcast, all others by a join.

Where vectors spread so evenly that no bound prunes, the units of a label grow
with the square of its blocks (see README).

Defined cases: vectors of different lengths never link; a vector that can't
link has n_links 0 and is its own component; a null vec_id isn't a minimum, and
a component without any id has a null component_id; rows that repeat a vec_id
are told apart by a row number and link as copies; ties at the threshold link;
long vectors are handled like any other; vec_id is read as a 64-bit integer,
and its values from 2**62 on aren't supported (an error); an empty table gives
an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import connected_components, dropped, join_once, written

THRESHOLD = 0.93
#: Points of a block at most, about.
BLOCK = 8192
#: Bounds on the centres of all labels together, of one label, and on a label's sample from which they come.
CENTRES, CENTRES_EACH, CENTRE_SAMPLE = 4096, 256, 1024
#: Nodes of at most so many points aren't cut further.
LEAF = 16
#: Added to distances that prune, for rounding of sqrt(2 - 2 cos) near zero.
SLACK = 1e-6
#: The same for cosines in single precision, which only prune.
SLACK32 = 1e-4
_CHUNK = 256
#: Points from here on stand for vectors of which no row has an id.
_NO_ID = 1 << 62


def _net(points: np.ndarray, members: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
    """A net of the members: its centres, and for each member the position of its nearest centre, at most half away."""
    centres = np.zeros(0, int)
    for at in range(0, len(members), _CHUNK):
        new = members[at : at + _CHUNK]
        if len(centres):
            new = new[_distance((points[new] @ points[centres].T).max(axis=1)) > half]
        if len(new):
            near = _distance(points[new] @ points[new].T) <= half
            covered, chosen = np.zeros(len(new), bool), []
            for k in range(len(new)):
                if not covered[k]:
                    chosen.append(k)
                    covered |= near[k]
            centres = np.concatenate([centres, new[chosen]])
    owner = np.concatenate([np.argmax(points[members[at : at + _CHUNK]] @ points[centres].T, axis=1) for at in range(0, len(members), _CHUNK)])
    return centres, owner


def _distance(cosine):
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Node:
    """A centre (a point), the radius that covers the node's members, and its children, if it has any."""

    __slots__ = ("centre", "radius", "members", "children")

    def __init__(self, centre: int, radius: float, members: np.ndarray, children: Nodes | None):
        self.centre, self.radius, self.members, self.children = centre, radius, members, children


class Nodes(list):
    """Nodes side by side, with their centres and radii as arrays."""

    def __init__(self, nodes):
        super().__init__(nodes)
        self.centres = np.array([n.centre for n in self], int)
        self.radii = np.array([n.radius for n in self])
        self.single = np.array([len(n.members) == 1 for n in self], bool)


class CoverTree:
    """Nested nets of distinct unit vectors: a node's children lie within its radius and cover its points with half of it."""

    def __init__(self, points: np.ndarray):
        self.points, self.single = points, points.astype(np.float32)
        self.root = Nodes([self._node(np.arange(len(points)), 0, 2.0)])

    def _node(self, members: np.ndarray, centre: int, most: float) -> Node:
        radius = float(_distance(self.points[members] @ self.points[centre]).max()) if len(members) > 1 else 0.0
        if len(members) <= LEAF or radius == 0:
            return Node(centre, radius, members, None)
        half = min(radius, most) / 2
        centres, owner = _net(self.points, members, half)
        if len(centres) == 1:
            return Node(centre, radius, members, None)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        children = [self._node(members[order[cuts[k] : cuts[k + 1]]], c, half) for k, c in enumerate(centres.tolist()) if cuts[k] < cuts[k + 1]]
        return Node(centre, radius, members, Nodes(children))


def dual_pairs(a: CoverTree, b: CoverTree, threshold: float):
    """Pieces (i, j, whole) that hold all pairs of points of cosine at or above the threshold, each once.

    Pairs (i[k], j[k]), or with whole each of i with each of j. For a tree with
    itself each pair of different points comes in one of its two orders.
    """
    same, reach = a is b, math.sqrt(2 - 2 * threshold)
    stack = [(a.root, b.root, same)]
    while stack:
        xs, ys, mirror = stack.pop()
        for at in range(0, len(xs), _CHUNK):
            first = at if mirror else 0  # of a list with itself only the upper triangle
            cosines = a.single[xs.centres[at : at + _CHUNK]] @ b.single[ys.centres[first:]].T
            far = xs.radii[at : at + _CHUNK, None] + ys.radii[None, first:]
            far = reach + SLACK if not far.any() else far + (reach + SLACK)
            i, j = np.nonzero(cosines >= 1 - far * far / 2 - SLACK32)
            i, j = i + at, j + first
            if mirror:
                i, j = i[i <= j], j[i <= j]
            both = xs.single[i] & ys.single[j]
            one = both & ((i != j) if mirror else True)
            for k in range(0, int(one.sum()), 1 << 15):
                p, q = xs.centres[i[one][k : k + (1 << 15)]], ys.centres[j[one][k : k + (1 << 15)]]
                hit = np.einsum("ij,ij->i", a.points[p], b.points[q]) >= threshold
                yield p[hit], q[hit], False
            for x, y, itself in ((xs[m], ys[n], mirror and m == n) for m, n in zip(i[~both].tolist(), j[~both].tolist(), strict=True)):
                apart = 0.0 if itself else float(_distance(a.points[x.centre] @ b.points[y.centre]))
                if apart + x.radius + y.radius <= reach - SLACK:
                    yield x.members, y.members, True
                elif x.children is None and y.children is None:
                    p, q = np.nonzero(a.points[x.members] @ b.points[y.members].T >= threshold)
                    if itself:
                        p, q = p[p < q], q[p < q]
                    yield x.members[p], y.members[q], False
                else:
                    stack.append((x.children or Nodes([x]), y.children or Nodes([y]), itself))


def _forest(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    while len(i):
        x, y = label[i], label[j]
        open_ = x != y
        if not open_.any():
            break
        i, j, low = i[open_], j[open_], np.minimum(x, y)[open_]
        np.minimum.at(label, x[open_], low)
        np.minimum.at(label, y[open_], low)
        while (label != label[label]).any():
            label = label[label]
    return label


def join_blocks(ids_a, x, weight_a, ids_b=None, y=None, weight_b=None, threshold: float = THRESHOLD):
    """Links within a block of distinct vectors, or between two: ids, weighted counts, roots of a spanning forest."""
    same = ids_b is None
    a = CoverTree(x)
    b = a if same else CoverTree(y)
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    weight = weight_a if same else np.concatenate([weight_a, weight_b])
    order = np.argsort(ids, kind="stable")  # labels are ranks, so that a root is the least id
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    count, label, shift = np.zeros(len(ids), np.int64), np.arange(len(ids)), 0 if same else len(ids_a)
    for i, j, whole in dual_pairs(a, b, threshold):
        if not len(i) or not len(j):
            continue
        j = j + shift
        if whole and i[0] == j[0]:  # a node with itself
            count[i] += weight[i].sum() - weight[i]
            i, j = i[1:], np.full(len(i) - 1, i[0])
        elif whole:
            count[i] += weight[j].sum()
            count[j] += weight[i].sum()
            i, j = np.concatenate([i, np.full(len(j), i[0])]), np.concatenate([np.full(len(i), j[0]), j])
        else:
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
        label = _forest(rank[i], rank[j], label)
    return ids, count, ids[order][label[rank]]


def unit_rows(packed, dtype) -> np.ndarray:
    """Packed vectors of one length as a matrix of unit rows in double precision."""
    x = np.frombuffer(b"".join(packed), dtype).reshape(len(packed), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares stay finite; it doesn't change a cosine
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """Per row: vec_id, row, label, n (length), key (digest; null: can't link) and x (packed); and the type of x."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    single = isinstance(rows.schema["x"].dataType.elementType, T.FloatType)
    dtype = "<f4" if single else "<f8"
    if not single:
        rows = rows.withColumn("x", F.col("x").cast("array<double>"))

    def run(batches):
        for batch in batches:
            x = batch["x"]
            size = np.nan_to_num(np.asarray(x.value_lengths().to_numpy(zero_copy_only=False), float)).astype(int)
            values = x.flatten().to_numpy(zero_copy_only=False).astype(dtype) + np.array(0, dtype)  # no negative zeros
            ends = np.cumsum(size)
            starts = ends - size
            total = lambda v: np.concatenate([[0], np.cumsum(v)])
            bad, some = total(~np.isfinite(values)), total(values != 0)
            good = (bad[ends] == bad[starts]) & (some[ends] > some[starts]) & np.asarray(batch["label"].is_valid())
            data, width = values.tobytes(), values.itemsize
            packed = [data[s * width : e * width] if g else None for s, e, g in zip(starts.tolist(), ends.tolist(), good.tolist(), strict=True)]
            keys = [None if p is None else hashlib.sha256(p).digest() for p in packed]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["row"], batch["label"], pa.array(size, pa.int32()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                ["vec_id", "row", "label", "n", "key", "x"],
            )

    kind = T.StructType([*rows.schema.fields[:3], T.StructField("n", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("x", T.BinaryType())])
    return rows.mapInArrow(run, kind), dtype


def centres_of(points: DataFrame, dtype: str, block: int) -> dict[tuple, np.ndarray]:
    """Centres (unit rows) of the largest parts that have more than a block, CENTRES in all; from bounded samples of them."""
    order = F.xxhash64("key")
    most = points.groupBy("label", "n").count().where(F.col("count") > block)
    parts = most.orderBy(F.desc("count"), "label", "n").limit(CENTRES // 2).collect()
    chosen, left = {}, CENTRES
    for r in parts:
        want = min(CENTRES_EACH, 2 * math.ceil(r["count"] / block), left)
        if want > 1:
            chosen[r["label"], r["n"]], left = want, left - want
    if not chosen:
        return {}
    wanted = points.sparkSession.createDataFrame(
        [(*k, w) for k, w in chosen.items()], T.StructType([points.schema["label"], points.schema["n"], T.StructField("want", T.IntegerType())])
    )
    near = points.join(F.broadcast(wanted), ["label", "n"])
    sample = near.withColumn("k", F.row_number().over(Window.partitionBy("label", "n").orderBy(order))).where(F.col("k") <= F.least(F.lit(CENTRE_SAMPLE), 4 * F.col("want")))

    def top(batch: pa.Table) -> pa.Table:
        x = unit_rows(batch["x"].to_pylist(), dtype)
        want, radius, found = batch["want"][0].as_py(), 1.0, np.zeros(1, int)
        while radius > 1e-3:  # the finest net of halving radii that isn't larger than wanted
            centres, _ = _net(x, np.arange(len(x)), radius)
            if len(centres) > want:
                break
            found, radius = centres, radius / 2
        if len(found) < 2:  # an even spread: any sample serves as well
            found = np.arange(min(want, len(x)))
        return pa.table({"label": batch["label"].slice(0, 1), "n": batch["n"].slice(0, 1), "centres": pa.array([x[found].tobytes()], pa.binary())})

    got = sample.groupBy("label", "n").applyInArrow(top, T.StructType([points.schema["label"], points.schema["n"], T.StructField("centres", T.BinaryType())])).collect()
    return {(r["label"], r["n"]): np.frombuffer(r["centres"], np.float64).reshape(-1, r["n"]) for r in got}


_ASSIGNED = [T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]


def _by_part(batch):
    """(part, positions) of a batch's rows."""
    parts: dict[tuple, list[int]] = {}
    for k, part in enumerate(zip(batch["label"].to_pylist(), batch["n"].to_pylist(), strict=True)):
        parts.setdefault(part, []).append(k)
    return [(part, np.array(at)) for part, at in parts.items()]


def links(points: DataFrame, dtype: str, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Of points(point, label, n, key, weight, x): link counts (point, links) and edges (u, v).

    Only points of one label and length are compared.
    """
    spark = points.sparkSession
    reach = math.sqrt(2 - 2 * threshold) + SLACK
    centres = centres_of(points, dtype, block)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for batch in batches:
            cell, away, x = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0), batch["x"]
            for part, at in _by_part(batch):
                if part in shared.value:
                    cosine = unit_rows([x[k].as_py() for k in at.tolist()], dtype) @ shared.value[part].T
                    cell[at] = cosine.argmax(axis=1)
                    away[at] = _distance(cosine.max(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], [*batch.schema.names, "cell", "away"])

    placed = points if not centres else written(points.mapInArrow(assign, T.StructType([*points.schema.fields, *_ASSIGNED])))
    if not centres:
        placed = placed.withColumn("cell", F.lit(0)).withColumn("away", F.lit(2.0).cast("double"))
    cells = placed.groupBy("label", "n", "cell").agg(F.ceil(F.count("*") / float(block)).cast("int").alias("subs"), F.max("away").alias("radius"))
    # The cells of parts with centres are at most CENTRES.
    known: dict[tuple, dict[int, tuple[int, float]]] = {}
    if centres:
        cells = written(cells)
        parts = spark.createDataFrame(list(centres), T.StructType([points.schema["label"], points.schema["n"]]))
        for r in cells.join(F.broadcast(parts), ["label", "n"], "left_semi").collect():
            known.setdefault((r["label"], r["n"]), {})[r["cell"]] = (r["subs"], r["radius"])
    table = spark.sparkContext.broadcast(known)
    sized = placed.join(cells.drop("radius"), ["label", "n", "cell"]).drop("away")
    fields = ["point", "label", "n", "weight", "x"]

    def deal(batches):
        for batch in batches:
            here = np.zeros(batch.num_rows, np.int64)
            units: list = [None] * batch.num_rows
            x, cell = batch["x"], batch["cell"].to_numpy()
            hashed, subs = batch["hashed"].to_numpy(), batch["subs"].to_numpy()
            for part, at in _by_part(batch):
                if part not in table.value:
                    for k in at.tolist():
                        here[k] = hashed[k] % subs[k]
                        units[k] = range(subs[k])
                    continue
                held, middle = table.value[part], shared.value[part]
                names = sorted(held)
                base = dict(zip(names, np.cumsum([0, *(held[c][0] for c in names)])[:-1].tolist(), strict=True))
                radii = np.array([held[c][1] for c in names])
                own = np.array([names.index(c) for c in cell[at].tolist()])
                away = _distance(unit_rows([x[k].as_py() for k in at.tolist()], dtype) @ middle[names].T)
                apart = _distance(middle[names] @ middle[names].T)
                mine = away[np.arange(len(at)), own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = (away**2 - mine[:, None] ** 2) / (2 * apart[own])
                reaches = (away <= radii[None, :] + reach) & ~(border > reach)
                reaches[np.arange(len(at)), own] = True
                for row, k in enumerate(at.tolist()):
                    here[k] = base[cell[k]] + hashed[k] % subs[k]
                    units[k] = [base[names[c]] + s for c in np.flatnonzero(reaches[row]).tolist() for s in range(held[names[c]][0])]
            pairs = [[{"lo": min(h, u), "hi": max(h, u), "second": h > u} for u in us] for h, us in zip(here.tolist(), units, strict=True)]
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("second", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*(batch[f] for f in fields), pa.array(pairs, kind)], [*fields, "units"])

    hashed = sized.withColumn("hashed", F.pmod(F.xxhash64("key"), F.lit(1 << 40)))
    dealt = hashed.mapInArrow(deal, T.StructType([points.schema[f] for f in fields]).add("units", T.ArrayType(T.StructType().add("lo", "long").add("hi", "long").add("second", "boolean"))))
    dealt = dealt.withColumn("u", F.explode("units")).select(*fields, "u.*")

    def compare(group: pa.Table) -> pa.Table:
        second = group["second"].to_numpy(zero_copy_only=False).astype(bool)
        ids, weight = group["point"].to_numpy(), group["weight"].to_numpy()
        x = unit_rows(group["x"].to_pylist(), dtype)
        if group["lo"][0].as_py() == group["hi"][0].as_py():
            sides = (ids, x, weight)
        elif second.any() and not second.all():
            sides = (ids[~second], x[~second], weight[~second], ids[second], x[second], weight[second])
        else:
            sides = None
        if sides is None:
            ids, count, root = ids[:0], weight[:0], ids[:0]
        else:
            ids, count, root = join_blocks(*sides, threshold=threshold)
        some = (count > 0) | (root != ids)
        return pa.table({"point": pa.array(ids[some], pa.int64()), "links": pa.array(count[some], pa.int64()), "root": pa.array(root[some], pa.int64())})

    found = written(dealt.groupBy("label", "n", "lo", "hi").applyInArrow(compare, "point long, links long, root long"))
    if centres:
        dropped(placed, cells)
    return found.groupBy("point").agg(F.sum("links").alias("links")), found.where("point <> root").select(F.col("point").alias("u"), F.col("root").alias("v"))


def near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    found, dtype = prepared(vectors, id_col, vector_col, label_col)
    # Row numbers and digests are fixed by writing them.
    rows = written(found.withColumn("vec_id", F.when(F.col("vec_id") >= _NO_ID, F.raise_error("ids from 2**62 on aren't supported").cast("long")).otherwise(F.col("vec_id"))))
    some = rows.where("key is not null")
    points = written(
        some.groupBy("label", "n", "key").agg(F.min("vec_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("weight"), F.min("x").alias("x"))
        .select("label", "n", "key", F.coalesce("least", F.lit(_NO_ID) + F.col("row")).alias("point"), "weight", "x")
    )
    counts, edges = links(points, dtype, threshold, block)
    components = connected_components(edges)
    named = (
        points.select("label", "n", "key", "point", "weight")
        .join(counts, "point", "left")
        .join(components.withColumnRenamed("vertex", "point"), "point", "left")
        .select("label", "n", "key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "point").alias("c"))
    )
    out = join_once(some.select("vec_id", "label", "n", "key"), named, ["label", "n", "key"]).select("vec_id", "n_links", "c")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("c"))
    out = out.unionByName(alone).withColumn("component_id", F.when(F.col("c") < _NO_ID, F.col("c")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
