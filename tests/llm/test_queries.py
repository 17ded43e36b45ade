"""The registered queries over whole small tables: against their SQL, or against brute force."""

import hashlib
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers

from glyphflow.llm import bpe, pii
from glyphflow.llm.registry import ORACLE_SQL, QUERIES
from test_operators import components, encoding, slow_fingerprint

SMALL = "/root/testdata/sf0.001"


def read(name, columns, sf=SMALL):
    return duckdb.sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    got, want = QUERIES[name](spark, SMALL), con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())


class _Article(HTMLParser):
    """Text blocks within <article>, by the standard library."""

    def __init__(self):
        super().__init__()
        self.inside, self.skipped, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skipped += self.inside and (tag in ("script", "style", "aside", "form") or tag == "div" and dict(attrs).get("class") in ("ad", "comments"))
        if tag not in ("b", "i", "em", "strong", "a", "span", "br"):
            self.blocks.append("")
        if tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skipped -= bool(self.skipped and tag in ("script", "style", "aside", "form", "div"))
        if tag not in ("b", "i", "em", "strong", "a", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.blocks[-1] += data


def test_op2(spark):
    """The test tables' pages have their text in one article."""
    pages = read("pages", "page_id, html")
    got = {r["page_id"]: r["text"] for r in QUERIES["op2_html_text"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    right = 0
    for page_id, html in pages:
        parser = _Article()
        parser.feed(html)
        parser.close()
        right += got[page_id] == "\n".join(t for b in parser.blocks if (t := " ".join(b.split())))
    assert right >= 0.98 * len(pages)


def test_op4(spark):
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t in read("documents", "doc_id, text")}
    rows = QUERIES["op4_packing"](spark, SMALL).collect()
    covered, sequences = {k: 0 for k in want}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == covered[r["doc_id"]] and r["doc_tokens"] == len(want[r["doc_id"]])
        covered[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == {k: len(v) for k, v in want.items()}
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 1024 and int(ends[-1]) & int(ends[-1] - 1) == 0


def test_op5(spark):
    got = {r["doc_id"]: r for r in QUERIES["op5_pii"](spark, SMALL).collect()}
    patterns = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x, d: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x, d: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x, d: 13 <= len(d) <= 19 and pii.luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x, d: 9 <= len(d) <= 15),
    }
    for k, t in read("documents", "doc_id, text"):
        spans, counts = [], {}
        for kind, (pattern, passes) in patterns.items():
            hits = [m for m in re.finditer(pattern, t or "") if passes(m[0], re.sub("[^0-9]", "", m[0]))]
            counts[f"n_{kind}"] = len(hits)
            spans += [f"{kind}:{m.start()}:{m.end()}" for m in hits]
        assert all(got[k][c] == n for c, n in counts.items())
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(got[k]["spans"].split(",")) | {""}


def test_op6(spark):
    enc = encoding(bpe.VOCABULARY)
    got = {r["doc_id"]: r for r in QUERIES["op6_byte_bpe"](spark, SMALL).collect()}
    for k, t in read("documents", "doc_id, text"):
        ids = enc.encode_ordinary(t or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_op7(spark):
    docs = sorted(read("documents", "doc_id, text"))
    fps = [slow_fingerprint(t) for _, t in docs]
    root = components(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op7_simhash_near_dedup"](spark, SMALL).collect()}
    assert got == {k: (f"{f:016x}", docs[c][0]) for (k, _), f, c in zip(docs, fps, root, strict=True)}


def test_op8(spark):
    """Held-out documents: how the score ranks them, and how the threshold parts them."""
    sf = "/root/testdata/sf0.01"
    labels = dict(read("labels", "doc_id, quality", sf))
    rows = QUERIES["op8_quality"](spark, sf).collect()
    assert len(rows) == len(read("documents", "doc_id", sf)) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [(labels[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for y, s, _ in held if y == 1], [s for y, s, _ in held if y == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.98 and np.mean([y == p for y, _, p in held]) > 0.93


def test_op10(spark):
    langs = dict(read("documents", "doc_id, lang"))
    rows = QUERIES["op10_language_id"](spark, SMALL).collect()
    held = [r for r in rows if r["held_out"] and langs[r["doc_id"]] is not None]
    assert len(rows) == len(langs) and np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.95
