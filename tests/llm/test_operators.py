"""Each operator on a small table with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash

from glyphflow.llm import bpe, common, cover_tree, exact_dedup, language_id, licenses, packing, pii, quality, simhash
from glyphflow.llm.common import connected_components
from glyphflow.llm.license_texts import KNOWN

BASE = "the quick brown fox jumps over the lazy dog and runs through the forest until night comes again "
TEXTS = [None, "", " \t\n", "one", "One  two", BASE * 30, BASE * 30 + "x", BASE.upper() * 30, "mail a.b@c.org, +1 (743) 555-3824", "4111 1111 1111 1111 or 10.0.0.256", "naïve 漢字 😀  x", BASE * 900, "a" * 5000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, digest string, fp long, v_fp long, label int"


def table(spark, texts=TEXTS):
    rows = [(k, t, "en" if k % 2 else "fr", "s", 0, 1, "d", 7, 7, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[3:5], (None, "no id", None, None, None, 1, None, None, None, None)], SCHEMA)


def components(n, pairs):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 130)}}


def test_licenses(spark):
    mit = KNOWN["MIT"].replace("sublicense", "sub-licence").upper()
    df = table(spark, ["Copyright (c) 2020 Me\n" + mit, KNOWN["Zlib"], "x\nReleased under the MIT licence!\n", None, "", KNOWN["ISC"] + "\nmore", "licensed UNDER cc by-nc 4.0"])
    got = {r["doc_id"]: (r["license_id"], r["notices"], r["license_digest"]) for r in licenses.license_scan(df).collect()}
    assert got[0][0] == "MIT" and got[1][0] == "Zlib" and got[2][:2] == (None, "MIT") and got[3][:2] == (None, "") and got[5][0] is None and got[6][:2] == (None, "CC-BY-NC-4.0")
    assert got[0][2] == licenses.digest("Copyright (c) 2020 Me\n" + mit)
    assert licenses.license_scan(df).count() == df.count() and licenses.license_scan(df.limit(0)).count() == 0
    assert {r["notices"] for r in licenses.license_scan(df, notices={}).collect()} == {""}


def test_notices_of_ones_own(spark):
    """Notices that don't speak of a licence, and one without any telling word, are found too."""
    df = table(spark, ["Do what you like with it\nx", "free of charge - use it", "2.0", "a\n(2) 0\nb", "LICENCE"])
    notices = {"A": "Do what you like with it.", "B": "Free of charge; use it!", "C": "2.0", "D": "license"}
    got = {r["doc_id"]: r["notices"] for r in licenses.license_scan(df, notices=notices).collect()}
    assert [got[k] for k in range(5)] == ["A", "B", "C", "C", "D"]


FOLDER = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FOLDER.exists(), reason="the system keeps no licence texts")
def test_whole_public_licences(spark):
    """Whole texts of long licences, as they are and with case, spacing and copyright lines changed, hit their digests."""
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "GFDL-1.3": "GFDL-1.3"}
    texts = {n: (FOLDER / f).read_text() for f, n in names.items() if (FOLDER / f).exists()}
    rows = []
    for n, t in texts.items():
        rows += [(n, t), (n, "Copyright (C) 1999 Somebody\n" + t.upper().replace("\n", "  \r\n")), (n, t.replace("license", "licence").replace("*", ""))]
        rows += [(None, t[: len(t) // 2]), (None, t + " more")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(df).collect()}
    assert [got[k] for k in range(len(rows))] == [n for n, _ in rows]


def test_exact_dedup(spark):
    df = table(spark)
    rows = exact_dedup.exact_dedup(df, hot_rows=2).collect()
    assert len(rows) == df.count()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = {r["doc_id"]: hashlib.sha256(norm(r["text"]).encode()).hexdigest() for r in df.collect()}
    assert all(r["text_sha256"] == want[r["doc_id"]] for r in rows)
    groups = {}
    for r in rows:
        groups.setdefault(r["text_sha256"], []).append(r)
    for rs in groups.values():
        assert sum(r["kept"] for r in rs) == 1 and {r["group_size"] for r in rs} == {len(rs)}
        assert {r["keep_id"] for r in rs} == {min((r["doc_id"] for r in rs if r["doc_id"] is not None), default=None)}
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashed = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


@pytest.mark.parametrize("tile", [1024, 2])
def test_simhash(spark, tile):
    df = table(spark)
    rows = simhash.near_dedup(df, tile=tile).collect()
    data = sorted({(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] is not None})
    fps = [slow_fingerprint(t) for _, t in data]
    root = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    want = {data[k][0]: (format(fps[k], "016x"), data[root[k]][0]) for k in range(len(fps))}
    assert len(rows) == df.count()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows if r["doc_id"] is not None} == want
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} - {None} == {c for _, c in want.values()}
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_simhash_tiles_lose_no_link(spark):
    draw = np.random.default_rng(3)
    centre = draw.integers(0, 2**63, 3, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 4), replace=False)) for c in centre for _ in range(60)}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp long, vertex long"), tile=4)
    got = {r["vertex"]: r["component"] for r in connected_components(edges).collect()}
    want = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert [got.get(k, k) for k in range(len(fps))] == want


def test_large_tiles_are_passed_on():
    """Runs cut by batches at any place: small tiles give edges, large ones their rows, each row once."""
    import pyarrow as pa

    draw = np.random.default_rng(8)
    tile = np.sort(np.concatenate([np.repeat(5, 40), np.repeat(9, 7), np.arange(20, 40), np.repeat(50, 12), np.repeat(60, 3)]))
    rows = {"tile": tile, "fp": draw.integers(0, 1 << 62, len(tile)), "vertex": np.arange(len(tile)), "mask": np.full(len(tile), 3)}
    for size in (1, 3, 10, 100):
        batches = [pa.RecordBatch.from_pydict({c: v[k : k + size] for c, v in rows.items()}) for k in range(0, len(tile), size)]
        out = pa.Table.from_batches(list(simhash._forests(iter(batches), 64, 10)))
        kept = out.filter(out["fp"].is_valid())
        assert sorted(kept["vertex"].to_pylist()) == sorted(rows["vertex"][(tile == 5) | (tile == 50)].tolist())
        joined = out.filter(out["u"].is_valid())
        got = components(len(tile), zip(joined["u"].to_pylist(), joined["v"].to_pylist(), strict=True))
        small = [k for k in range(len(tile)) if tile[k] not in (5, 50)]
        assert [got[k] for k in small] == [int(np.flatnonzero(tile == tile[k])[0]) for k in small]


@pytest.mark.parametrize(("block", "kind"), [(1024, "float"), (16, "float"), (4, "double")])
def test_cover_tree(spark, block, kind):
    draw = np.random.default_rng(5)
    x = draw.standard_normal((20, 8))
    x = np.concatenate([x, x[:15] + 0.12 * draw.standard_normal((15, 8)), x[:6] + 0.02, x[3:5], 3 * x[:1]])
    rows = [(k, v.tolist(), int(k % 2)) for k, v in enumerate(x.astype(np.float32))]
    bad = [(100, None, 0), (101, [0.0] * 8, 0), (102, [float("nan")] * 8, 0), (103, [None] * 8, 0), (104, rows[0][1], None), (105, [1.0, 2.0], 0), (106, [], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], f"vec_id long, embedding array<{kind}>, label int, x string")
    got = {r["vec_id"]: r for r in cover_tree.near_dedup(df, block=block).collect()}
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= 0.93) & np.array([[a[2] == b[2] for a in rows] for b in rows])
    np.fill_diagonal(link, False)
    root = components(len(v), zip(*np.nonzero(link), strict=True))
    for k in range(len(v)):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (link[k].sum(), root[k], root[k] == k)
    for k in range(100, 107):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert cover_tree.near_dedup(df.limit(0)).count() == 0


def test_cover_tree_clusters_in_cells(spark):
    """Tight clusters, of which one holds a third of the rows, dealt to cells: no link lost, some units never shipped."""
    draw = np.random.default_rng(9)
    centre = draw.standard_normal((40, 12))
    which = np.concatenate([np.zeros(200, int), draw.integers(0, 40, 400)])
    x = (centre[which] + 0.15 * draw.standard_normal((600, 12))).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist(), "one") for k, v in enumerate(x)], "vec_id long, embedding array<float>, label string")
    got = {r["vec_id"]: r for r in cover_tree.near_dedup(df, block=50).collect()}
    v = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = v @ v.T >= 0.93
    np.fill_diagonal(link, False)
    root = components(600, zip(*np.nonzero(link), strict=True))
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in range(600)] == [(link[k].sum(), root[k]) for k in range(600)]


def test_cover_tree_ids(spark):
    """Repeated and null ids: copies link, a null id is no minimum."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(5, a, 0), (5, a, 0), (None, a, 0), (None, b, 0), (None, b, 0), (7, None, 0)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, cover_tree.near_dedup(df).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 1, None, True), (None, 1, None, True), (7, 0, 7, True)], key=str)
    with pytest.raises(Exception, match="aren't supported"):
        cover_tree.near_dedup(spark.createDataFrame([(1 << 62, a, 0)], df.schema)).collect()


def test_dual_traversal_is_exact():
    draw = np.random.default_rng(2)
    x = draw.standard_normal((700, 6))
    x = np.concatenate([x, x[:300] + 0.05 * draw.standard_normal((300, 6)), x[:1] + 0.01 * draw.standard_normal((200, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, weight = draw.permutation(len(x)), draw.integers(1, 4, len(x))
    link = x @ x.T >= 0.93
    np.fill_diagonal(link, False)
    _, count, root = cover_tree.join_blocks(ids, x, weight)
    assert (count == link @ weight).all()
    want = components(len(x), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True)])
    assert [want[i] for i in ids] == root.tolist()
    _, count, _ = cover_tree.join_blocks(ids[:500], x[:500], weight[:500], ids[500:], x[500:], weight[500:])
    assert (count == np.concatenate([link[:500, 500:] @ weight[500:], link[500:, :500] @ weight[:500]])).all()


def encoding(name):
    import base64

    with open(public_tokenizers.path(name), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 1 << 9), (64, 16)])
def test_bpe(spark, chunk, overlap):
    enc, df = encoding(bpe.VOCABULARY), table(spark, [*TEXTS, "x " * 300 + " " * 200 + "b\n\n c  d" * 40, "漢字かな" * 9_000, " " * 40_000, "\n \t" * 12_000 + "x", "b " * 20_000 + "z" * 150_000 + " c" * 40_000])
    rows = bpe.digests(df, chunk=chunk, overlap=overlap).collect()
    assert len(rows) == df.count()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in rows:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.digests(df.limit(0)).count() == 0


def test_bpe_pieces_of_random_texts():
    """Pieces of chunks, each by itself, give the library's ids of the whole text."""
    draw, c = random.Random(6), bpe.Coder(public_tokenizers.path(bpe.VOCABULARY))
    enc = encoding(bpe.VOCABULARY)
    for _ in range(3_000):
        text = "".join(draw.choice(["ab", "The", " ", "  ", "\n", "\r\n", "é", "漢", "😀", "'s", "'LL", "12", "\u00a0", "\t", "!?", "\x1c", "\u2003", "\u200b", "z" * 70]) for _ in range(draw.randint(1, 120)))
        ids = bpe.encoded_text(text, c, chunk=24, overlap=6)
        assert ids == enc.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_packing(spark):
    """Against the tokenizers library: each id of each row in exactly one piece, sequences gapless and full or powers of two."""
    whole = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*TEXTS, "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n\n x", "<|endoftext", "  two   spaces \n\n\tand lines\n "]
    draw = random.Random(4)
    texts += ["".join(draw.choice(["ab", " ", "\n", "é", "漢", "😀", "'s", "'LL", "12", "\u00a0", "\t", "!?", "\x1c", "\u2003", "<|endoftext|>"]) for _ in range(draw.randint(1, 60))) for _ in range(300)]
    df = table(spark, texts)
    want = {r["doc_id"]: np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in df.collect()}
    rows = packing.packed(df).collect()
    docs, sequences = {}, {}
    for r in rows:
        assert r["ids"] == want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes() and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for s, n in sorted(pieces):
            assert s == at
            at += n
        assert at & (at - 1) == 0 and at <= 1024
    times = Counter(r["doc_id"] for r in df.collect())
    assert set(docs) == set(times)
    for k, pieces in docs.items():  # a repeated id has its pieces as often as it has rows
        covered = Counter(i for s, n in pieces for i in range(s, s + n))
        assert covered == {i: times[k] for i in range(len(want[k]))}
    assert packing.packed(df.limit(0)).count() == 0


def test_hilbert_neighbours():
    keys = {packing.hilbert_key([x, y, z], 3): (x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert sorted(keys) == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(keys[k], keys[k + 1], strict=True)) == 1 for k in range(511))


def test_pii(spark):
    plain = lambda p, t: [(m.start(), m.end(), m[0]) for m in re.finditer(p, t)]
    texts = [*TEXTS, "1.2.3.4.5.6.7.8 000001.2.3.4 a@b a@b.c@d.e x.@y-z.w", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "+1234567 +12 34-56 78.90", "9" * 6000]
    df = table(spark, texts)
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        spans = [("email", s, e) for s, e, _ in plain(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        spans += [("ip", s, e) for s, e, x in plain(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in x.split("."))]
        spans += [("card", s, e) for s, e, x in plain(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and pii.luhn(d)]
        spans += [("phone", s, e) for s, e, x in plain(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", x)) <= 15]
        joined = [f"{a}:{s}:{e}" for a, s, e in spans]
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(got[k]["spans"].split(",")) | {""}
        assert got[k]["n_ip"] == sum(a == "ip" for a, _, _ in spans)
    out = {r["doc_id"]: r for r in pii.redacted(df).collect()}
    assert out[8]["text"] == "mail [EMAIL], [PHONE]" and out[8]["n_chars"] == len(out[8]["text"]) and out[0]["text"] is None
    assert pii.find(df.limit(0)).count() == 0


def test_language(spark):
    en = ["the cat sat on the mat and the dog ran off with that thing", "this is what they were doing when the rain came over the hill"] * 20
    fr = ["le chat est sur la table et les enfants sont dans la maison", "nous avons vu que les gens du village sont partis avec eux"] * 20
    rows = [(k, t, "en" if k < 40 else "fr", 1) for k, t in enumerate(en + fr)] + [(80, None, None, 1), (81, "12 34 !", "en", 1), (82, "", "fr", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.classify(df, model).collect()}
    assert all(got[k]["lang_pred"] == ("en" if k < 40 else "fr") and 0 <= got[k]["score"] <= 1 for k in range(80))
    assert all(got[k]["lang_pred"] == "und" and got[k]["rejected"] for k in (80, 81, 82))
    kept = language_id.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == 80
    assert language_id.classify(df.limit(0), language_id.fit(df.limit(0))).count() == 0


def test_ngram_blocks(monkeypatch):
    text = "Ünïcode words, and more of them. " * 50
    whole = language_id.ngram_counts(text)
    monkeypatch.setattr(language_id, "_BLOCK", 64)
    assert (language_id.ngram_counts(text) == whole).all()


def test_quality(spark):
    good, bad = [f"Some quite ordinary sentence number {k} of the text goes here." for k in range(60)], [f"BUY!! NOW### {k} $$$ !! CLICK### %%%" for k in range(60)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate([*good, *bad, None, ""])], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)] + [(3, 1, 0), (121, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert all(got[k]["predicted"] == int(k < 60) and 0 <= got[k]["score"] <= 1 for k in range(120)) and len(got) == 122
    empty = quality.fit(docs, labels.limit(0))
    assert quality.score(docs.limit(0), empty).count() == 0


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p["doc_id"] for p in pieces} == surviving(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "simhash_dedup", "pii", "packing"]


def surviving(docs):
    """Ids that language ID, exact and SimHash dedup leave, by brute force."""
    norm, first, fps = set(), [], {}
    model = language_id.fit(docs)
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"])):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        if not model.predict(r["text"])[2] and key not in norm:
            norm.add(key)
            first.append(r)
            fps[r["doc_id"]] = slow_fingerprint(r["text"])
    ids = [r["doc_id"] for r in first]
    root = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= 2])
    return {ids[k] for k in root}


def test_pipeline_over_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, long and empty texts, clashing columns, and an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    en = [f"the cat number {k} sat on the mat and the dog of the house ran off with that {'very ' * (k % 9)}thing" for k in range(60)]
    texts = [None, "", " ", "12 34", *en, en[3], en[3].replace("cat", "cat "), BASE * 2_000, "write to a@b.org or to the other one that was there"]
    rows = [(k, t, None if k % 7 == 0 else "en", None, None, 1, "d", 5, b"x") for k, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, en[5], "en", "s", 3, 1, "d", 5, b"x"), (None, "a text of its own without an id in the table", "en", "s", 3, 1, "d", 5, b"x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, digest string, gone long, found binary").coalesce(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == surviving(docs)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.schema == docs.schema, name
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("tracked", [2, 1024])
def test_join_once(spark, tracked):
    """A join with one row a key, of which one has most rows and some have none; nulls join nothing."""
    rows = [(k % 7 if k % 3 else 0, k) for k in range(300)] + [(None, 1), (99, 2)]
    df, named = spark.createDataFrame(rows, "a long, spot long").repartition(5), spark.createDataFrame([(k, f"v{k}") for k in range(8)] + [(None, "x")], "a long, v string")
    got = sorted(map(tuple, common.join_once(df, named, ["a"], tracked).select("a", "spot", "v").collect()))
    assert got == sorted((a, s, f"v{a}") for a, s in rows if a is not None and a < 8)
    assert common.join_once(df.limit(0), named, ["a"]).count() == 0


def test_shared_folder_is_named_off_local_masters(spark, monkeypatch):
    class Away:
        conf = type("", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("", (), {"get": staticmethod(lambda *a: None)}))})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Away())


def test_intermediates_are_dropped(spark):
    since = common.mark()
    a, b = common.written(spark.range(3)), common.written(spark.range(4))
    common.dropped_since(spark, since, b)
    assert b.count() == 4 and common.mark() == since + 1
    with pytest.raises(Exception, match="PATH|path|exist"):
        spark.read.parquet(a._glyphflow_path)
    common.dropped(b)
    common.dropped(b)
    assert common.mark() == since
