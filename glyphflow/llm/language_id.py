"""Language ID by nearest centroid: TF-IDF n-gram vectors, several centroids a language, rejection by distance.

Byte 1- to 3-grams of the lower-cased text are hashed to DIMS counts. The
classifier is fitted on a bounded sample of labelled rows (PER_LANGUAGE rows a
language, chosen by a hash of id and text): idf weights, and by spherical
k-means CENTROIDS unit vectors per language. Each language's centroids are found
in a task of its own. A document takes the language of the centroid of greatest
cosine; one whose best cosine is below that language's reach, for texts of its
length, is rejected.

Every whole text is scored in one pass of Arrow batches, without a shuffle. All
languages that the labels have are learned; what reaches the driver, and the
broadcast model, is CENTROIDS * DIMS floats for each of them.

Defined cases: a null text or one without a letter gives ``und``, score 0,
rejected; without any labelled row all is ``und``; very long texts are counted
block by block; ties go to the language that sorts first; rows repeat as they
come; an empty table gives an empty result; other columns aren't inputs, and
accepted() returns them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import dropped, held_out, written

DIMS_BITS = 11
DIMS = 1 << DIMS_BITS
CENTROIDS = 3
#: Bound on a language's training sample.
PER_LANGUAGE = 400
#: A language's reach by band: this part of the cosine that all but OUTLIERS of its own sample have among texts of as many n-grams or more. A word or two tell little, so there it is wide.
REACH = (0.3, 0.6, 0.6, 0.6)
#: Share of a sample that may itself lie beyond: mislabelled rows and junk, which mustn't widen the reach.
OUTLIERS = 0.02
#: Least counts of n-grams from which a reach of its own holds; cosines of longer texts scatter less.
BANDS = (0, 200, 800, 3000)
UNKNOWN = "und"

_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_BLOCK = 1 << 20


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of the byte 1- to 3-grams; none has two spaces in a row. Long texts go block by block."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" "
    out = np.zeros(DIMS, np.float64)
    for at in range(0, max(len(data) - 2, 1), _BLOCK):
        a = np.frombuffer(data[at : at + _BLOCK + 2], np.uint8).astype(np.uint32)
        last = at + _BLOCK + 2 >= len(data)
        space = a == 32
        pair = (a[:-1] << np.uint32(8)) | a[1:]
        pair_ok = ~(space[:-1] & space[1:])
        three = (pair[:-1] << np.uint32(8)) | a[2:]
        one = a if last else a[:-2]
        two, two_ok = (pair, pair_ok) if last else (pair[:-1], pair_ok[:-1])
        grams = np.concatenate([one[one != 32], two[two_ok] + np.uint32(1 << 25), three[pair_ok[:-1] & pair_ok[1:]]])
        out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - DIMS_BITS), minlength=DIMS)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a unit row each
    owner: np.ndarray  # index of its language
    reach: np.ndarray  # least accepted cosine, by language and band of length

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine in 0 to 1, and whether it is rejected."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        counts = ngram_counts(text)
        v = counts * self.idf
        norm = float(np.sqrt(v @ v))
        if norm == 0:
            return self.languages[0], 0.0, True
        cosines = self.centroids @ (v / norm).astype(np.float32)
        best = int(np.argmax(cosines))
        score = min(1.0, max(0.0, float(cosines[best])))
        k = int(self.owner[best])
        return self.languages[k], score, bool(score < self.reach[k, band_of(counts)])


def band_of(counts: np.ndarray) -> int:
    return int(np.searchsorted(BANDS, counts.sum(), "right")) - 1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    k = min(k, len(x))
    chosen = [0]
    near = x @ x[0]
    for _ in range(k - 1):  # farthest first
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        at = np.argmax(x @ centres.T, axis=1)
        centres = _unit(np.stack([x[at == i].sum(axis=0) if (at == i).any() else centres[i] for i in range(k)]))
    return centres


def weights(documents: int, containing: np.ndarray) -> np.ndarray:
    """Inverse document frequencies, from how many sampled texts contain each n-gram."""
    return np.log((1 + documents) / (1 + containing)) + 1


def centroids_of(counts: np.ndarray, idf: np.ndarray, centroids: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """One language's centroids, and its reach by band; a band that no sampled text is long enough for has the band before's."""
    x = _unit(counts * idf)
    found = _spherical_kmeans(x, centroids)
    best, size, reach = (x @ found.T).max(axis=1), counts.sum(axis=1), []
    for part, least in zip(REACH, BANDS, strict=True):
        reach.append(part * float(np.quantile(best[size >= least], OUTLIERS)) if (size >= least).any() else reach[-1] if reach else 0.0)
    return found, np.array(reach)


def train(vectors: np.ndarray, langs: list[str], centroids: int = CENTROIDS) -> Model:
    """From rows of n-gram counts and their languages, all at hand."""
    idf = weights(len(vectors), (vectors > 0).sum(axis=0)) if len(vectors) else np.ones(DIMS)
    which = np.array(langs)
    return _model(idf, [(name, *centroids_of(vectors[which == name], idf, centroids)) for name in sorted(set(langs))])


def _model(idf: np.ndarray, found: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    if not found:
        return Model([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, len(BANDS))))
    owner = np.concatenate([np.full(len(c), i) for i, (_, c, _) in enumerate(found)])
    return Model([name for name, _, _ in found], idf, np.concatenate([c for _, c, _ in found]).astype(np.float32), owner, np.stack([reach for _, _, reach in found]))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per: int = PER_LANGUAGE) -> Model:
    """Learns from the rows that aren't held out and have a text and a language."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return train(np.zeros((0, DIMS)), [])
    part = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], 2.0 * per / r["count"])])
    order = F.xxhash64("doc_id", "text")
    # The hash thins each language to about 2 * per rows before they are ranked.
    thin = rows.where(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < part[F.col("lang")])
    ranked = thin.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")))

    def vectors(batches):
        for batch in batches:
            got = [(t, k) for t, k in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for _, k in got], pa.string()), pa.array([ngram_counts(t).astype(np.float32).tobytes() for t, _ in got], pa.binary())],
                ["lang", "vector"],
            )

    sampled = written(ranked.where(F.col("n") <= per).select("text", "lang").mapInArrow(vectors, "lang string, vector binary"))

    def matrix(group: pa.Table) -> np.ndarray:
        return np.stack([np.frombuffer(v, np.float32) for v in sorted(group["vector"].to_pylist())]).astype(np.float64)

    def containing(group: pa.Table) -> pa.Table:
        x = matrix(group)
        return pa.table({"n": pa.array([len(x)], pa.int64()), "df": pa.array([(x > 0).sum(axis=0).astype(np.float64).tobytes()], pa.binary())})

    seen = sampled.groupBy("lang").applyInArrow(containing, "n long, df binary").collect()
    if not seen:
        return train(np.zeros((0, DIMS)), [])
    idf = weights(sum(r["n"] for r in seen), sum(np.frombuffer(r["df"], np.float64) for r in seen))

    def centre(group: pa.Table) -> pa.Table:
        found, reach = centroids_of(matrix(group), idf)
        return pa.table({"lang": group["lang"].slice(0, 1), "centroids": pa.array([found.astype(np.float32).tobytes()], pa.binary()), "reach": pa.array([reach.tolist()], pa.list_(pa.float64()))})

    got = sampled.groupBy("lang").applyInArrow(centre, "lang string, centroids binary, reach array<double>").collect()
    dropped(sampled)
    return _model(idf, sorted(((r["lang"], np.frombuffer(r["centroids"], np.float32).reshape(-1, DIMS), np.array(r["reach"])) for r in got), key=lambda x: x[0]))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score, rejected."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            got = [shared.value.predict(x.as_py()) for x in batch["text"]]
            columns = [batch["doc_id"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    kind = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return rows.mapInArrow(score, kind)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model doesn't reject, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for batch in batches:
            mask = [not shared.value.predict(x.as_py())[2] for x in batch[text_col]]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
