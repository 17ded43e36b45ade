import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphflow.functions import conversion, detection
from glyphflow.operators import matching, tools, vector
from glyphflow.plans import configs, queries, texts
from glyphflow.sources import arpa, files
from glyphflow.sources.dictionaries import MissingDictionary, Registry

SMALL = "/root/testdata/sf0.001"


def layer(**entries):
    out = matching.Layer()
    for k, v in entries.items():
        out.add(k, v.split())
    return out


def test_prefixes():
    one = layer(ab="AB", abc="ABC")
    assert matching.longest_prefix(one, "abcd") == (3, "ABC")
    assert matching.longest_prefix(one, "abx") == (2, "AB")
    assert matching.longest_prefix(one, "xb") is None
    assert matching.group_longest_prefix([layer(ab="HI"), layer(abc="LO")], "abcd") == (2, "HI")
    assert matching.group_longest_prefix([layer(zz="Z"), layer(abc="LO")], "abcd") == (3, "LO")
    assert matching.longest_prefix_multi(matching.layer_of(["出\t出 齣"]), "出门") == (3, ["出", "齣"])


@pytest.mark.parametrize(
    ("config", "text", "expected"),
    [("jp2t", "万与", "萬與"), ("t2jp", "萬與", "万与"), ("t2tw", "裏面純喫茶喫", "裡面純喫茶吃"), ("jp2t", "弁当", "辨當"), ("jp2t", "弁護士", "辯護士"), ("jp2t", "予備", "預備"), ("t2tw", "", "")],
)
def test_golden(config, text, expected):
    assert configs.resolve(config).convert(text) == expected


def test_ascii_lead_and_merged_priority():
    group = matching.Group([matching.layer_of(*(configs.dictionary(Registry(), n) for n in ("TWPhrasesRev", "TWVariantsRevPhrases", "TWVariantsRev")))])
    assert matching.stage(group, "核心") == "核心"  # the last dictionary of a merged group wins
    assert matching.stage(group, "A型肝炎") == "A型肝炎"
    assert matching.stage(group, "我A型肝炎") == "我甲型肝炎"


def test_missing_dictionaries_are_named():
    with pytest.raises(MissingDictionary, match="STCharacters|STPhrases|TSCharacters|TSPhrases"):
        configs.resolve("s2t")
    extra = {"STPhrases": ["软件\t軟件"], "STCharacters": ["软\t軟", "件\t件", "买\t買", "汉\t漢"], "TSCharacters": ["軟\t软", "買\t买", "漢\t汉"], "TSPhrases": []}
    registry = Registry(extra=extra)
    assert configs.resolve("s2t", registry).convert("hello 汉 买软件") == "hello 漢 買軟件"
    assert configs.resolve("s2t", registry, [("软件", "軟體")]).convert("买软件") == "買軟體"


def test_all_configs_resolve_with_a_full_registry():
    registry = Registry(extra={"STPhrases": ["一出\t一出"], "STCharacters": ["汉\t漢"], "TSCharacters": ["漢\t汉"], "TSPhrases": []})
    for config in configs.CONFIGS:
        assert isinstance(configs.resolve(config, registry).convert("汉漢 abc"), str)


def test_segments_concatenate():
    group = configs.resolve("tw2t").segmentation
    for text in texts.SEEDS:
        assert "".join(s for s, _ in matching.segments(group, text)) == text


def test_ngrams():
    model = arpa.parse(queries.ARPA)
    assert model.pick("齣", ["齣", "出"]) == "齣" and model.pick("", ["齣", "出"]) == "出" and model.pick("演", ["齣", "出"]) == "出"
    group = matching.Group([matching.layer_of(["出\t齣 出", "一\t一"])])
    assert matching.convert("演出", None, [group], model, "bigram") == "演出"
    assert matching.convert("一出", None, [group], model, "bigram") == "一齣"
    assert matching.convert("演出", None, [group]) == "演齣"


def test_strategies_agree(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts.SEEDS)] + [(99, None)], "id int, t string")
    for config in ("t2tw", "t2hk", "jp2t", "t2jp", "hk2t"):
        row = df.select("t", conversion.convert("t", config, strategy="arrow").alias("a"), conversion.convert("t", config, strategy="regex").alias("r"), conversion.convert("t", config).alias("c"))
        plan = configs.resolve(config)
        for r in row.collect():
            assert r["a"] == r["r"] == r["c"] == (None if r["t"] is None else plan.convert(r["t"]))


@pytest.mark.parametrize(
    ("text", "region", "confidence"),
    [("hello world 123\n", None, None), ("こんにちは世界", "jp-n", 50), ("他感染了A型肝炎", "cn-tw", 50), ("他去了西維珍尼亞州", "cn-hk", 50), ("我買了新的滑鼠很好用", "cn-tw", 40), (None, None, None)],
)
def test_detection(spark, text, region, confidence):
    found = spark.createDataFrame([(text,)], "t string").select(detection.detect("t").alias("d")).first()["d"]
    assert (found and (found["region"], found["confidence"])) == (region and (region, confidence))


def test_file_detection(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("我買了新的滑鼠很好用".encode() * 400)
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    got = {r["path"].rsplit("/", 1)[1]: (r["region"], r["confidence"]) for r in files.detections(files.read_bytes(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": ("cn-tw", 40), "b.txt": ("unknown", 0)}


def test_custom_entries():
    assert conversion.custom_entries("a b|c d e") == [("a", "b"), ("c", "d e")]
    for bad in ({}, "ab", [("a",)], [("", "x")], 5):
        with pytest.raises(ValueError):
            conversion.custom_entries(bad)


def test_streaming_equals_batch(spark, tmp_path):
    from glyphflow.streaming.convert import converted

    rows = spark.createDataFrame([(t,) for t in texts.SEEDS], "text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = converted(spark.readStream.schema("text string").parquet(str(tmp_path / "in")), "t2tw")
    q = stream.writeStream.format("memory").queryName("out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("out").collect())) == sorted(map(tuple, converted(rows, "t2tw").collect()))


def test_streaming_counts_by_window(spark, tmp_path):
    """Counts over a stream equal those of the batch; detection keeps no state of its own."""
    from glyphflow.streaming.convert import detected, variant_counts

    schema = "ts timestamp, text string"
    rows = spark.createDataFrame([(t, k) for k, t in enumerate(texts.SEEDS)], "text string, k int").select(F.timestamp_seconds(F.col("k") * 60).alias("ts"), "text").repartition(2)
    rows.write.parquet(str(tmp_path / "in"))
    stream = variant_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = detected(rows).groupBy(F.window("ts", "10 minutes"), "region").count()
    plain = lambda df: sorted((str(r["window"]["start"]), str(r["region"]), r["count"]) for r in df.collect())
    assert plain(spark.table("counted")) == plain(want)


@pytest.mark.parametrize(
    "name",
    ["convert_s2twp", "convert_tw2sp", "convert_jp2t", "convert_custom_t2s", "segments_s2t", "prefix_match", "character_tallies", "detect_sample", "auto_convert_cn_t", "ngram_convert", "config_json", "project_phrases",
     "merged_group", "reverse_HKVariants", "tofu_entries", "parity_report", "cjk_agreement", "sized_corpus", "region_pairs"],
)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).where(F.col("converted").isNotNull()).count() > 0


def test_the_form_in_the_jvm_cuts_texts_into_pieces(spark):
    """Random keys, longer and overlapping ones among them, over long texts: pieces, not characters, are looked up, and no stack overflows."""
    draw, alphabet = random.Random(5), "汉字𠮷国の臺\nx"
    for _ in range(6):
        made = matching.Layer()
        for _ in range(draw.randint(1, 60)):
            key = draw.choice("汉字𠮷国臺") + "".join(draw.choices(alphabet, k=draw.randint(0, 3)))
            made.add(key, ["".join(draw.choices(alphabet, k=draw.choice([1, 1, 2])))])
        plan = configs.Plan(None, [matching.Group([made])])
        rows = [None, "", *("".join(draw.choices(alphabet, k=draw.choice([3, 30, 300]))) for _ in range(40)), "国" * 200_000 + "の" * 200_000]
        got = spark.createDataFrame(list(enumerate(rows)), "id int, t string").select("id", conversion.convert_with("t", plan, "regex").alias("r")).collect()
        assert {r["id"]: r["r"] for r in got} == {k: t if t is None else plan.convert(t) for k, t in enumerate(rows)}


def test_parity_moves_no_texts(spark):
    """Both forms count alike, whatever is null, and the shuffle has digests and counts alone."""
    rows = spark.createDataFrame([(k, draw[0], draw[1]) for k, draw in enumerate([("a", "a"), ("a", "b"), ("a", None), (None, "a"), ("", ""), ("a" * 9999, "a" * 9999)])], "id int, l string, r string").withColumn("config", F.lit("c"))
    sides = [rows.select("config", "id", F.col(c).alias("converted")) for c in "lr"]
    joined, within = tools.parity(*sides, ["config", "id"]), tools.parity_within(rows, F.col("l"), F.col("r"))
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in within.collect()} == {("c", "pass", 3), ("c", "mismatch", 2), ("c", "unsupported", 1)}
    assert "sha2" in joined._jdf.queryExecution().optimizedPlan().toString() and "Join" not in within._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in queries.QUERIES["parity_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_agreement_of_whole_batches(spark, monkeypatch):
    """Against a count of positions, bytes and characters, whatever the lengths; texts are neither split nor gone through in lambdas."""
    draw = random.Random(9)
    rows = [tuple(None if draw.random() < 0.05 else "".join(draw.choices("一丁七龥鿿ꀀ𠮷a，\n汉", k=draw.choice([0, 1, 5, 60]))) for _ in "ab") for _ in range(700)]
    plain = []
    for a, b in rows:
        x, y = ([c for c in t or "" if "一" <= c <= "鿿"] for t in (a, b))
        share = lambda p, q: sum(c == d for c, d in zip(p, q, strict=False)) / max(len(p), len(q)) if len(p) or len(q) else 1.0
        plain.append({"agreement": share(x, y), "of_bytes": share("".join(x).encode(), "".join(y).encode()), "lost": "".join(sorted(set(x) - set(y)))})
    arrays = [pa.array([r[k] for r in rows], pa.string()) for k in range(2)]
    assert tools.agreed(*arrays).to_pylist() == plain and tools.agreed(*(a.slice(0, 0) for a in arrays)).to_pylist() == []
    monkeypatch.setattr(vector, "CHARS", 100)
    assert tools.agreed(*(pa.concat_arrays([pa.array(["一"]), a]).slice(1) for a in arrays)).to_pylist() == plain
    df = spark.createDataFrame(rows[:50], "a string, b string")
    got = df.select(tools.cjk_agreement(F.col("a"), F.col("b")), tools.byte_agreement(F.col("a"), F.col("b")), F.array_join(tools.lost_cjk(F.col("a"), F.col("b")), "")).collect()
    assert [tuple(r) for r in got] == [tuple(x.values()) for x in plain[:50]]
    plan = queries.QUERIES["cjk_agreement"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "split(" not in plan
