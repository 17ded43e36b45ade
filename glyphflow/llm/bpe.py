"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks of about CHUNK characters that overlap by OVERLAP
or more; a text of one chunk is encoded where it lies, chunks of longer ones are
dealt to all tasks. Each task pre-tokenises the overlaps at its chunk's two
ends and stitches at the first boundary where both neighbours' pre-tokens
resynchronise. Only boundaries between a character that isn't white space and
one that is serve: no pre-token holds such a pair, so they hold in the whole
text, wherever a chunk began and whatever a Unicode version counts as a letter,
and two neighbours find the same one without hearing of each other. An overlap
without any is made longer until it has one or the text ends, so a chunk grows
only with its longest run of text that has no such boundary.

The pieces between stitches are encoded in parallel; of a text only its pieces'
ids meet again, in order. Decoding concatenates the ids' raw bytes.

Defined cases: a null text is the empty text with no ids; rows repeat as they
come (long ones are told apart by a row number); texts without white space are
one piece; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import written

CHUNK, OVERLAP = 1 << 15, 1 << 9
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_coders: dict[str, Coder] = {}


class Coder:
    """One vocabulary in one worker: pre-tokens, ids of pieces, bytes of ids."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimals = list(map(str, range(len(self.bytes))))

    def boundary(self, overlap: str) -> int | None:
        """End of the first pre-token that white space follows and that doesn't end in it."""
        for m in self.pattern.finditer(overlap):
            e = m.end()
            if e < len(overlap) and overlap[e] in " \n\t\r" and not overlap[e - 1].isspace():
                return e
        return None

    def encode(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def spelt(self, ids) -> str:
        """The ids as decimal numbers, joined by commas."""
        return ",".join(map(self.decimals.__getitem__, ids))


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def chunks_of(text: str, c: Coder, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, end, length of the overlap with the next; 0 for the last) of a text's chunks."""
    out, begin = [], 0
    while True:
        end = begin + chunk
        after, reach = end - overlap, overlap  # where the next chunk begins
        while end < len(text) and (at := c.boundary(text[after : after + reach])) is None:
            reach *= 2
            end = after + reach
        if end >= len(text):
            return [*out, (begin, len(text), 0)]
        if reach > overlap:  # the next chunk begins an overlap before the boundary that was found
            end = after + at + 1
            after = max(after, end - overlap)
        out.append((begin, end, end - after))
        begin = after


def piece(chunk: str, before: int, after: int, c: Coder) -> str:
    """A chunk's own piece, between the stitches in its overlaps with the chunk before and after it (0: none)."""
    first = c.boundary(chunk[:before]) if before else 0
    return chunk[first : len(chunk) - after + c.boundary(chunk[len(chunk) - after :])] if after else chunk[first:]


def encoded_text(text: str, c: Coder, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """A text's ids by chunks and pieces, all in one place."""
    ids, before = [], 0
    for begin, end, after in chunks_of(text, c, chunk, overlap):
        ids += c.encode(piece(text[begin:end], before, after, c))
        before = after
    return ids


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, ids (little-endian unsigned 32-bit, packed), decoded (raw bytes from the ids)."""
    return _each(docs, id_col, text_col, vocabulary, chunk, overlap, "ids binary, decoded binary", lambda c, ids: (np.array(ids, "<u4").tobytes(), c.decode(ids)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the comma-joined ids), decoded_sha256."""

    def of(c: Coder, ids: list[int]):
        return len(ids), hashlib.sha256(c.spelt(ids).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _each(docs, id_col, text_col, vocabulary, chunk, overlap, "n_tokens long, ids_sha256 string, decoded_sha256 string", of)


def _each(docs, id_col, text_col, vocabulary, chunk, overlap, kind, of) -> DataFrame:
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_field = T.StructField("doc_id", rows.schema["doc_id"].dataType)
    fields = T.StructType.fromDDL(kind)
    arrow = [{"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in fields]

    def batch_of(ids, results):
        columns = [pa.array([r[k] for r in results], t) for k, t in enumerate(arrow)]
        return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", *fields.names])

    def whole(batches):
        c = coder(path)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                yield batch_of(part["doc_id"], [of(c, encoded_text(x.as_py(), c, chunk, overlap)) for x in part["text"]])

    def cut(batches):
        c = coder(path)
        for batch in batches:
            for k in range(batch.num_rows):
                text, before = batch["text"][k].as_py(), 0
                for n, (begin, end, after) in enumerate(chunks_of(text, c, chunk, overlap)):
                    columns = [batch["doc_id"].slice(k, 1), batch["row"].slice(k, 1), *(pa.array([x], pa.int64()) for x in (n, before, after)), pa.array([text[begin:end]])]
                    yield pa.RecordBatch.from_arrays(columns, dealt.names)
                    before = after

    def pieces(batches):
        c = coder(path)
        for batch in batches:
            ids = [
                np.array(c.encode(piece(text, before, after, c)), "<u4").tobytes()
                for text, before, after in zip(batch["chunk"].to_pylist(), batch["before"].to_pylist(), batch["after"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], batch["n"], pa.array(ids, pa.binary())], encoded_pieces.names)

    def joined(batches):
        c = coder(path)
        for batch in batches:
            for k in range(batch.num_rows):
                parts = sorted(batch["pieces"][k].as_py(), key=lambda r: r["n"])
                yield batch_of(batch["doc_id"].slice(k, 1), [of(c, np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist())])

    # The same cutting and stitching everywhere; only the chunks of texts that have several are worth sending to other tasks.
    out = T.StructType([id_field, *fields.fields])
    dealt = T.StructType([id_field]).add("row", "long").add("n", "long").add("before", "long").add("after", "long").add("chunk", "string")
    encoded_pieces = T.StructType([id_field]).add("row", "long").add("n", "long").add("ids", "binary")
    several = F.length("text") > chunk
    long = rows.where(several).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, dealt)
    # The row numbers are fixed before they are dealt, so a task that runs again can't give others.
    long = written(long).repartition("row", "n").mapInArrow(pieces, encoded_pieces)
    long = long.groupBy("row").agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), F.collect_list(F.struct("n", "ids")).alias("pieces"))
    return rows.where(~several).mapInArrow(whole, out).unionByName(long.select("doc_id", "pieces").mapInArrow(joined, out))
