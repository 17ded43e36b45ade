"""Longest-prefix look-ups as a Column function."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from glyphflow.operators import matching

PREFIX = pa.struct([("bytes", pa.int32()), ("value", pa.string()), ("candidates", pa.list_(pa.string()))])


def longest_prefix(text: Column | str, layers: list[list[str]]) -> Column:
    """struct<bytes, value, candidates> of what the text begins with; null if no key does, and for null.

    Layers are dictionary lines, in order of priority: the first layer with any
    prefix of the text decides, by its longest.
    """
    text = F.col(text) if isinstance(text, str) else text
    group = matching.Group([matching.layer_of(lines) for lines in layers])
    shared = SparkSession.active().sparkContext.broadcast(group)

    def run(texts: pa.Array) -> pa.Array:
        def one(t: str | None):
            m = shared.value.match(t, 0) if t else None
            return m and {"bytes": len(m[2].encode()), "value": m[1].values[m[2]], "candidates": list(m[1].candidates[m[2]])}

        return pa.array([one(t) for t in texts.to_pylist()], PREFIX)

    return F.arrow_udf(run, "struct<bytes:int,value:string,candidates:array<string>>")(text)
