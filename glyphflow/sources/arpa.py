"""ARPA n-gram models: parsed to a model, or to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.operators.matching import Ngrams

SCHEMA = "order int, w array<string>, logprob double"
#: Tokens that a line of each order may have; trigrams with a back-off weight aren't read.
_TOKENS = {1: (2, 3), 2: (3, 4), 3: (4, 4)}


def entries(text: str):
    """(order, words, log10 probability); a number that can't be read is minus infinity."""
    order = 0
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith("\\"):
            order = next((n for n in _TOKENS if line.startswith(f"\\{n}-grams")), 0)
        elif line and not line.startswith("#") and order:
            tokens = line.split()
            least, most = _TOKENS[order]
            if least <= len(tokens) <= most:
                try:
                    p = float(tokens[0])
                except ValueError:
                    p = float("-inf")
                yield order, tuple(tokens[1 : 1 + order]), p


def parse(text: str) -> Ngrams:
    model = Ngrams()
    for order, words, p in entries(text):
        model.orders[order][words] = p
    return model


def read(spark: SparkSession, path: str) -> Ngrams:
    """A model from any store that Spark reads; models are small enough to be shared whole."""
    return parse(spark.read.text(path, wholetext=True).first()[0])


def table(spark: SparkSession, model: Ngrams) -> DataFrame:
    return spark.createDataFrame([(n, list(w), p) for n, ws in model.orders.items() for w, p in ws.items()], SCHEMA)


def pick(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Of rows(id, prev, candidates) the likeliest candidate: (id, pick), by a join on bigrams."""
    bigrams = model.where("order = 2").select(F.col("w")[0].alias("b_prev"), F.col("w")[1].alias("b_cand"), "logprob")
    each = rows.select("id", F.coalesce(F.when(F.col("prev") != "", F.col("prev")), F.lit("<s>")).alias("prev"), F.posexplode("candidates").alias("pos", "cand"))
    found = each.join(bigrams, (F.col("prev") == F.col("b_prev")) & (F.col("cand") == F.col("b_cand")), "left")
    order = F.struct(F.coalesce("logprob", F.lit(float("-inf"))).alias("p"), (-F.col("pos")).alias("k"))
    return found.groupBy("id").agg(F.max_by("cand", order).alias("pick"))


def counts(model: DataFrame) -> DataFrame:
    """(order, n): how many n-grams of each order a model's table has."""
    return model.groupBy("order").agg(F.count("*").alias("n"))
