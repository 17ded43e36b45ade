"""Quality classifier: Bradley-Terry pairwise ranking, thresholded at a quantile of the scores.

Preference pairs (a document labelled 1 over one labelled 0) give feature
differences; logistic loss on them, by Newton steps, learns a linear score.
Candidate thresholds are the percentiles of the scores of *all* documents; the
one that separates the labelled sample best becomes the point where the
reported score is 0.7.

The fit uses a bounded sample of labelled rows (SAMPLE, by hash of the id) and
PAIRS pairs. Scoring is one pass of Arrow batches over the whole texts; only
(id, score) rows are written, and one row of percentiles reaches the driver.

Defined cases: a null text counts as the empty text, which is scored like any
other; very long texts are measured block by block; labels that are null or
belong to a null id are ignored, of several for one id the least counts, and of
several texts of one id one is learned from; without labels of both kinds every
score is 0.7; a score equal to the cut is predicted 1; rows repeat as they come;
an empty table gives an empty result; columns other than the ones named aren't
read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import held_out, written

#: Bounds of the fit: labelled rows, and preference pairs drawn from them.
SAMPLE, PAIRS = 8_000, 40_000
CUT = 0.7
RIDGE = 1e-3
#: Standardised features beyond this many deviations are drawn in to it.
CLIP = 8.0
#: Classes of bytes; their frequencies and those of their pairs are features.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".,;:?'\"()-", "!", "|", "#$%&*+=<>@^_~`/\\[]{}"]
N_CLASSES = len(_GROUPS) + 2
_CLASS = bytearray([N_CLASSES - 1] * 128 + [len(_GROUPS)] * 128)
for _i, _g in enumerate(_GROUPS):
    for _c in _g:
        _CLASS[ord(_c)] = _i
_CLASS = bytes(_CLASS)
N_FEATURES = N_CLASSES + N_CLASSES**2 + 9
_BLOCK = 1 << 20


def features(text: str | None) -> np.ndarray:
    text = text or ""
    data = text.encode("utf-8", "replace").translate(_CLASS)
    pairs = np.zeros(N_CLASSES**2)
    for at in range(0, len(data) - 1, _BLOCK):
        a = np.frombuffer(data[at : at + _BLOCK + 1], np.uint8).astype(np.int32)
        pairs += np.bincount(a[:-1] * N_CLASSES + a[1:], minlength=N_CLASSES**2)
    singles = np.bincount(np.frombuffer(data, np.uint8), minlength=N_CLASSES).astype(float)
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    shape = [
        math.log1p(len(words)),
        math.log1p(len(text) / n),
        len(set(words)) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(len(w) <= 3 for w in words) / n,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        float(not words),
    ]
    return np.concatenate([np.sqrt(singles / max(len(data), 1)), np.sqrt(pairs / max(len(data) - 1, 1)), shape])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Labelled rows' scores and labels, from which the threshold is chosen.
    scores: np.ndarray
    labels: np.ndarray

    def raw(self, text: str | None) -> float:
        return float(standardised(features(text), self.mean, self.scale) @ self.weights)


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Features as training and scoring alike see them, far outliers drawn in."""
    return np.clip((x - mean) / scale, -CLIP, CLIP)


def train(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7, rounds: int = 20) -> Model:
    """Bradley-Terry on preference pairs: P(i over j) is the logistic of w.(x_i - x_j)."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(N_FEATURES)
    w = np.zeros(N_FEATURES)
    if len(good) and len(bad):
        z, draw = standardised(x, mean, scale), np.random.default_rng(seed)
        d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = d.T @ (p - 1) / pairs + RIDGE * w
            hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
    return Model(mean, scale, w, standardised(x, mean, scale) @ w if len(x) else np.zeros(0), y)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from labelled rows that aren't held out; the sample of ids is bounded, so it is broadcast."""
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).alias("l_label"))
    known = known.where(F.col("l_label").isin(0, 1) & ~held_out(F.col("l_id"))).groupBy("l_id").agg(F.min("l_label").alias("l_label"))
    order, total = F.xxhash64("l_id"), max(known.count(), 1)
    thin = known.where(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < 2.0 * sample / total)
    chosen = thin.orderBy(order, "l_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))
    # One text of each id, however often the id repeats, so rows are bounded as ids are.
    rows = rows.groupBy("doc_id", "l_label").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))

    def measured(batches):
        for batch in batches:
            got = [features(x.as_py()).astype(np.float32).tobytes() for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.string()), batch["l_label"].cast(pa.int32()), pa.array(got, pa.binary())], ["doc_id", "label", "x"])

    got = sorted(rows.mapInArrow(measured, "doc_id string, label int, x binary").collect())
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]).astype(float) if got else np.zeros((0, N_FEATURES))
    return train(x, np.array([r["label"] for r in got], dtype=int))


def threshold(model: Model, quantiles: list[float]) -> float:
    """Of the candidate quantiles the one of greatest balanced accuracy on the labelled sample."""
    y, s = model.labels, model.scores
    if not quantiles or not (y == 1).any() or not (y == 0).any():
        return 0.0
    cuts = sorted(set(quantiles))
    cuts = [(a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False)] or cuts  # between neighbours, so that no document lies on a cut
    gain = np.array([((s >= q) & (y == 1)).sum() / (y == 1).sum() + ((s < q) & (y == 0)).sum() / (y == 0).sum() for q in cuts])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, score, predicted."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def raws(batches):
        for batch in batches:
            raw = [shared.value.raw(x.as_py()) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.float64())], ["doc_id", "raw"])

    kind = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("raw", "double")
    scored = written(rows.mapInArrow(raws, kind))
    levels = [i / 200 for i in range(1, 200)]
    cut = threshold(model, scored.agg(F.percentile_approx("raw", levels, 20_000).alias("q")).first()["q"] or [])
    shift = math.log(CUT / (1 - CUT)) + 1e-12
    scored = scored.withColumn("score", 1 / (1 + F.exp(-(F.col("raw") - F.lit(cut) + F.lit(shift)))))
    return scored.select("doc_id", "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
