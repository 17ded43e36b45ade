"""Reports and generators: parity, agreement, sampling, corpora, statistics, page texts."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphflow.operators import vector


def status(left: Column, right: Column) -> Column:
    """pass, mismatch, or unsupported if only left has a value."""
    return F.when(right.isNull(), "unsupported").when(left == right, "pass").otherwise("mismatch")


def parity(left: DataFrame, right: DataFrame, keys: list[str], value: str = "converted") -> DataFrame:
    """Counts by config and status of two tables' values; those are joined by their SHA-256, so that no text moves."""
    left, right = (df.select(*keys, F.sha2(F.col(value), 256).alias(side)) for df, side in ((left, "__l"), (right, "__r")))
    return _counted(left.join(right, keys, "left"))


def parity_within(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    """As parity(), of two values that each row has itself; nothing but counts moves."""
    return _counted(rows.select("config", left.alias("__l"), right.alias("__r")))


def _counted(both: DataFrame) -> DataFrame:
    return both.groupBy("config", status(F.col("__l"), F.col("__r")).alias("status")).agg(F.count("*").alias("n"))


def strided(entries: DataFrame, stride: int, most: int, order: str = "ord") -> DataFrame:
    """Every stride-th entry of each dictionary, most at the most (a sampling operator)."""
    n = F.row_number().over(Window.partitionBy("dict").orderBy(order))
    return entries.withColumn("n", n).where((F.col("n") - 1) % stride == 0).where((F.col("n") - 1) / stride < most).drop("n")


def repeated(spark: SparkSession, sentences: list[str], times: int) -> DataFrame:
    """(n, k, sentence): the sentences, over and over."""
    rows = spark.createDataFrame(list(enumerate(sentences)), "k int, sentence string")
    return spark.range(times).select(F.col("id").cast("int").alias("n")).join(F.broadcast(rows)).select("n", "k", "sentence")


def of_bytes(text: str, size: int) -> str:
    """The text repeated to so many UTF-8 bytes, cut back to a whole character."""
    data = text.encode()
    return (data * (size // len(data) + 1))[:size].decode("utf-8", "ignore") if data else ""


def of_bytes_column(text: Column, size: int) -> Column:
    """of_bytes() of each text of a column, without Python."""
    times = F.floor(F.lit(size) / F.greatest(F.octet_length(text), F.lit(1))) + 1
    long = F.repeat(text, times.cast("int"))
    cuts = [F.try_validate_utf8(F.substring(long.cast("binary"), 1, size - k).cast("string")) for k in range(4)]
    return F.coalesce(*cuts)


AGREEMENT = "struct<agreement:double,of_bytes:double,lost:string>"


def agreement(a: Column, b: Column) -> Column:
    """How far two texts agree in their Han characters (U+4E00 to U+9FFF), null counting as empty.

    agreement: share of positions, of the longer text's, at which the
    characters agree; of_bytes: the same over their UTF-8 bytes; lost: distinct
    characters that only the first text has, in order.
    """

    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return agreed(xs, ys)

    return F.arrow_udf(run, AGREEMENT)(a, b)


def agreed(xs: pa.Array, ys: pa.Array) -> pa.Array:
    """agreement() of whole batches, part by part."""
    found, at = [], 0
    for part in vector.parts_of(xs.fill_null("")):
        found.append(_agreed(part, ys.slice(at, len(part)).fill_null("")))
        at += len(part)
    same, of_bytes, lost = (np.concatenate(x) if k < 2 else [t for part in x for t in part] for k, x in enumerate(zip(*found, strict=True)))
    return pa.StructArray.from_arrays([pa.array(same), pa.array(of_bytes), pa.array(lost, pa.string())], ["agreement", "of_bytes", "lost"])


def _agreed(xs: pa.Array, ys: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    (x, x_row, x_size), (y, y_row, y_size) = _only_cjk(xs), _only_cjk(ys)
    # Each position that both texts have: the first of the row's characters on, as many as the shorter text has.
    both = np.minimum(x_size, y_size)
    p = vector._flat(np.cumsum(x_size) - x_size, both)
    q = vector._flat(np.cumsum(y_size) - y_size, both)
    row, p, q = np.repeat(np.arange(len(both)), both), x[p], y[q]
    # Han characters have three bytes: the upper four bits, and twice six.
    count = lambda equal: np.bincount(row[equal], minlength=len(both))
    bytes_ = count(p >> 12 == q >> 12) + count((p >> 6) & 63 == (q >> 6) & 63) + count(p & 63 == q & 63)
    most = np.maximum(x_size, y_size)
    share = lambda n, of: np.where(of == 0, 1.0, n / np.maximum(of, 1))
    # Characters by row: a table of flags of some rows at a time.
    lost, step = [""] * len(both), 256
    x_rows, y_rows = (np.searchsorted(r, np.arange(0, len(both) + step, step)) for r in (x_row, y_row))
    for k in range(0, len(both), step):
        flags = np.zeros((min(step, len(both) - k), _HAN[1] - _HAN[0]), bool)
        i = k // step
        flags[x_row[x_rows[i] : x_rows[i + 1]] - k, x[x_rows[i] : x_rows[i + 1]] - _HAN[0]] = True
        flags[y_row[y_rows[i] : y_rows[i + 1]] - k, y[y_rows[i] : y_rows[i + 1]] - _HAN[0]] = False
        for r, code in np.argwhere(flags).tolist():
            lost[k + r] += chr(code + _HAN[0])
    return share(count(p == q), most), share(bytes_, 3 * most), lost


#: Code points from U+4E00 to before U+A000.
_HAN = (0x4E00, 0xA000)


def _only_cjk(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Han characters of all texts, the row of each, and how many each row has."""
    batch = vector.batch_of(texts)
    han = (batch.codes >= _HAN[0]) & (batch.codes < _HAN[1])
    row = np.repeat(np.arange(len(texts)), np.diff(batch.rows))[han]
    return batch.codes[han], row, np.bincount(row, minlength=len(texts))


def cjk_agreement(a: Column, b: Column) -> Column:
    """Share of positions, of the longer text's, at which the Han characters agree."""
    return agreement(a, b)["agreement"]


def byte_agreement(a: Column, b: Column) -> Column:
    """As cjk_agreement, over the UTF-8 bytes of the Han characters."""
    return agreement(a, b)["of_bytes"]


def lost_cjk(before: Column, after: Column) -> Column:
    """Distinct Han characters that only the first text has, sorted."""
    return F.regexp_extract_all(agreement(before, after)["lost"], F.lit("(.)"), F.lit(1))


def pass_matrix(cases: DataFrame, modes: list[str]) -> DataFrame:
    """Of (case, mode, passed): a row per case, a column per mode."""
    return cases.groupBy("case").pivot("mode", modes).agg(F.bool_and("passed"))


def throughput(runs: DataFrame) -> DataFrame:
    """Of (name, mb, seconds): mean, population deviation and best, in MB/s."""
    rate = F.col("mb") / F.col("seconds")
    return runs.groupBy("name").agg(F.avg(rate).alias("mean"), F.stddev_pop(rate).alias("deviation"), F.max(rate).alias("best"))


class _Markdown(HTMLParser):
    skipped = {"script", "style", "nav", "aside", "footer"}
    before = {"h1": "\n\n# ", "h2": "\n\n## ", "h3": "\n\n### ", "h4": "\n\n#### ", "p": "\n\n", "div": "\n", "li": "\n- ", "br": "\n", "pre": "\n\n", "blockquote": "\n\n> ", "tr": "\n"}

    def __init__(self, container: str):
        super().__init__(convert_charrefs=True)
        self.container, self.out, self.inside, self.hidden = container, [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == self.container:
            self.inside += 1
        if tag in self.skipped:
            self.hidden += 1
        elif self.inside and not self.hidden:
            self.out.append(self.before.get(tag, ""))

    def handle_endtag(self, tag):
        if tag == self.container:
            self.inside -= 1
        if tag in self.skipped and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.out.append(data)


def page_markdown(source: str | None) -> str:
    """A page's article (else main, else body) as Markdown, without zero-width characters and blank runs."""
    if not source:
        return ""
    low = source.lower()
    container = next((t for t in ("article", "main", "body") if f"<{t}" in low), None)
    if container is None:
        return html.unescape(source).strip()
    parser = _Markdown(container)
    parser.feed(source)
    parser.close()
    text = "".join(parser.out)
    for c in "​‌‍﻿":
        text = text.replace(c, "")
    lines = [" ".join(line.split()) for line in text.split("\n")]
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).strip()


def markdown(page: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([page_markdown(p) for p in pages], dtype=object)

    return run(page)
