"""Packing along a space-filling curve.

1. One pass encodes every whole text and hashes its ids to a vector, which a
   fixed random projection takes to AXES dimensions; the Hilbert key of that
   point orders the documents. (key, id, ids) is written once.
2. A range sort by (key, id) puts neighbours into the same partition; the id
   breaks ties, so a hot key is spread over partitions too. The partitions are
   as many as the written bytes ask for.
3. Each partition lays its documents end to end into sequences of LENGTH
   tokens. What is left at its end is cut into sequences of power-of-two
   lengths, which aren't padded: no sequence holds padding.

Ids take two bytes each on disk and in the shuffle (the vocabulary has fewer
than 65,536). A range of equal (key, id) rows only arises from repeated ids.

Defined cases: a null text is the empty text, one end token; rows repeat as
they come, also with their ids, and each is laid whole; ties of the key go by
id; very long texts are cut into as many sequences as they fill; an empty table
gives an empty result; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import json
import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm.common import stored_bytes, written

LENGTH = 1024
END = 0
VOCABULARY = "byte_bpe_50k.json"
#: Hashed counts of ids, projected to so many axes of 2**BITS cells.
HASHED, AXES, BITS = 256, 3, 10
#: Bytes of ids that one range partition holds, about, while there are no more than RANGES of them.
RANGE_BYTES, RANGES = 16 << 20, 100_000

_coders: dict[str, Coder] = {}


def _byte_letters() -> dict[str, int]:
    """The public byte-to-character table of byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """One vocabulary in one worker.

    Texts are encoded by merge ranks; one that spells an added token goes to the
    tokenizers library itself, whose rules for such tokens hold then.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(map(letters.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self._whole = path, None
        if max([*ranks.values(), *(t["id"] for t in spec["added_tokens"])]) >= 1 << 16:
            raise ValueError("ids take two bytes; this vocabulary has larger ones")

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 16-bit numbers."""
        if any(x in text for x in self.added):
            if self._whole is None:
                self._whole = tokenizers.Tokenizer.from_file(self.path)
            ids = self._whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.bpe.encode_ordinary(text)
        return np.array(ids, "<u2").tobytes()


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def hilbert_key(cells: list[int], bits: int = BITS) -> int:
    """Position along the Hilbert curve of a point of non-negative cells (Skilling's transform)."""
    x, n = list(cells), len(cells)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> b & 1)
    return key


def projection(hashed: int = HASHED, axes: int = AXES, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((hashed, axes)) * 2


def curve_key(ids: np.ndarray, axes: np.ndarray) -> int:
    """The Hilbert key of a document by its ids' hashed, normalised counts."""
    counts = np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=HASHED)
    v = np.sqrt(counts)
    norm = np.sqrt(v @ v)
    at = (v / norm) @ axes if norm else np.zeros(axes.shape[1])
    cells = ((np.tanh(at / 2) + 1) / 2 * (1 << BITS)).astype(int)
    return hilbert_key([min(c, (1 << BITS) - 1) for c in cells.tolist()])


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per document: doc_id, curve_key and its ids with the end token (packed 16-bit)."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    axes, end = projection(), np.array([END], "<u2").tobytes()

    def run(batches):
        c = coder(path)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                ids = [c.encode(x.as_py()) + end for x in part["text"]]
                keys = [curve_key(np.frombuffer(x, "<u2")[:-1], axes) for x in ids]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "curve_key", "ids"])

    kind = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("curve_key", "long").add("ids", "binary")
    return rows.mapInArrow(run, kind)


def cut_points(total: int, length: int = LENGTH) -> list[int]:
    """Ends of the sequences that hold total tokens: full ones, then powers of two."""
    full = total // length
    ends, at = [length * k for k in range(1, full + 1)], full * length
    for b in range(length.bit_length() - 1, -1, -1):
        if (total - at) >> b & 1 and 1 << b < length:
            at += 1 << b
            ends.append(at)
    if at < total:  # only where length isn't a power of two
        ends.append(total)
    return ends


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve_key and, if asked for, ids.

    ids holds the piece's ids, little-endian unsigned 32-bit, packed.
    """
    rows = written(tokenised(docs, id_col, text_col, vocabulary))
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, min(RANGES, math.ceil(stored_bytes(rows) / RANGE_BYTES)))
    laid = rows.repartitionByRange(ranges, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        at = 0  # tokens of this partition so far
        held: list[list] = []  # pieces after the last full sequence
        for batch in batches:
            out: list[list] = []
            for k in range(batch.num_rows):
                ids = np.frombuffer(batch["ids"][k].as_buffer(), "<u2").astype("<u4")
                n, start = len(ids), 0
                while start < n:
                    offset = at % length
                    take = min(n - start, length - offset)
                    piece = ids[start : start + take].tobytes()
                    held.append([batch["doc_id"][k].as_py(), start, take, zlib.crc32(piece), n, base + at // length, offset, batch["curve_key"][k].as_py(), piece])
                    at, start = at + take, start + take
                    if at % length == 0:
                        out += held
                        held = []
            if out:
                yield rows_of(out)
        if held:
            yield rows_of(tail(held, at, length))

    id_type = pa.string() if isinstance(rows.schema["doc_id"].dataType, T.StringType) else pa.int64()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key"] + ["ids"] * with_ids

    def rows_of(pieces):
        types = [id_type] + [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pieces], t) for k, t in zip(range(len(names)), types, strict=False)], names)

    kind = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)])
    for name in names[1:]:
        kind = kind.add(name, "binary" if name == "ids" else "long")
    return laid.mapInArrow(run, kind)


def tail(held: list[list], at: int, length: int) -> list[list]:
    """The pieces of a partition's last, partial sequence, cut anew at powers of two."""
    ends = cut_points(at % length, length)
    out, k, begin = [], 0, 0
    for doc, start, take, _, n, sequence, offset, key, piece in held:
        while take:
            here = min(take, ends[k] - offset)
            part, piece = piece[: 4 * here], piece[4 * here :]
            out.append([doc, start, here, zlib.crc32(part), n, sequence + k, offset - begin, key, part])
            start, offset, take = start + here, offset + here, take - here
            if offset == ends[k]:
                begin, k = ends[k], k + 1
    return out
