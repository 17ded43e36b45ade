"""Dictionary jobs against what conversion uses, and the tables that public rules give."""

import pytest

from glyphflow.operators import dictionary_etl as etl
from glyphflow.operators import matching, tools
from glyphflow.plans import configs
from glyphflow.plans.queries import REGISTRY
from glyphflow.sources import arpa, cldr
from glyphflow.sources.dictionaries import MissingDictionary, Registry

ODD = ["# head", "", "k1\tv1 v2\r", "k2\tv1", "k1\tv3", "no tab", "k4\t ", "# @reverse-prefer: v1 k2", "k5\tv2 v2", "k1\tv1", "# @reverse-prefer: v2", "# @reverse-prefer: v3 x k1"]


def listed(df):
    return {r["key"]: list(r["values"]) for r in df.collect()}


def entries_of(lines):
    return {e[0]: e[1] for line in lines if (e := matching.parse_line(line))}


@pytest.mark.parametrize("name", ["TWVariants", "HKVariants", "JPShinjitaiCharacters", "odd"])
def test_reverse_agrees(spark, name):
    registry = Registry(extra=REGISTRY.extra | {"odd": ODD}, stand_ins=True)
    lines = registry.table(spark, name)
    assert listed(etl.reverse(etl.entries(lines), etl.preferences(lines))) == entries_of(configs.reversed_lines(registry.lines(name)))


def test_reverse_keeps_repeats_and_prefers():
    assert entries_of(configs.reversed_lines(ODD)) == {"v1": ["k2", "k1", "k1"], "v2": ["k1", "k5", "k5"], "v3": ["k1"]}


def test_parse_agrees(spark):
    registry = Registry(extra={"odd": ODD})
    assert listed(etl.parse(registry.table(spark, "odd"))) == entries_of(ODD)


def test_overlay_and_projection_agree(spark):
    both = etl.overlay(etl.parse(REGISTRY.table(spark, "STPhrases")), etl.parse(REGISTRY.table(spark, "STPhrases.patch")))
    assert listed(both) == entries_of(configs.dictionary(REGISTRY, "STPhrases"))
    from glyphflow.plans import queries

    got = {r["key"]: r["value"] for r in queries.project_phrases(spark, "").collect()}
    assert got == {k: v[0] for k, v in entries_of(configs.projected_lines(REGISTRY)).items()}


def test_merge_agrees(spark):
    lines = {"one": ["a\t1 2", "b\t3"], "two": ["a\t4", "c\t5 6"], "three": ["c\t7"]}
    registry = Registry(extra=lines)
    merged = etl.merge(etl.parse(registry.table(spark, *lines)), list(lines))
    got = {r["key"]: (r["value"], list(r["candidates"])) for r in merged.collect()}
    plain = matching.layer_of(*lines.values())
    assert got == {k: (v, list(plain.candidates[k])) for k, v in plain.values.items()} == {"a": ("4", ["1", "2"]), "b": ("3", ["3"]), "c": ("7", ["5", "6"])}


def test_tofu_agrees_and_complains(spark):
    from glyphflow.plans import queries

    registry = Registry(extra={"t": queries._TOFU})
    assert listed(etl.tofu_risk(registry.table(spark, "t"))) == entries_of(configs.tofu_lines(queries._TOFU)) == {"爲": ["𫢸"], "喫": ["吃", "𬜯"], "說": ["𬤇", "説"]}
    for bad in (["# @tofu-risk: x"], ["# @tofu-risk: x", "# y"], ["# @tofu-risk: x", "k\tk"], ["# @tofu-risk: x", ""]):
        with pytest.raises(ValueError):
            configs.tofu_lines(bad)
        with pytest.raises(Exception, match="tofu-risk"):
            etl.tofu_risk(Registry(extra={"t": bad}).table(spark, "t")).collect()


def test_stand_ins_only_if_asked_for():
    with pytest.raises(MissingDictionary):
        Registry().lines("STCharacters")
    registry = Registry(stand_ins=True)
    assert all(registry.has(n) for n in cldr.NAMES) and len(registry.lines("STCharacters")) > 2_000
    assert Registry(extra={"STCharacters": ["x\ty"]}, stand_ins=True).lines("STCharacters") == ("x\ty",)
    singles = [line.split("\t")[0] for n in ("STCharacters", "TSCharacters") for line in registry.lines(n)]
    assert all(len(k) == 1 for k in singles) and all("$" not in line and "{" not in line for n in cldr.NAMES for line in registry.lines(n))


@pytest.mark.parametrize(
    ("config", "text", "expected"),
    [
        ("s2t", "汉字计算机软件繁体", "漢字計算機軟件繁體"), ("t2s", "漢字計算機軟件繁體", "汉字计算机软件繁体"), ("s2twp", "鼠标信息", "滑鼠資訊"), ("s2hk", "鼠标", "鼠標"), ("s2tw", "鼠标", "鼠標"),
        ("tw2sp", "他感染了A型肝炎", "他感染了甲型肝炎"), ("tw2sp", "A型肝炎", "A型肝炎"), ("s2t", "hello 汉字 world 123", "hello 漢字 world 123"), ("s2t", "", ""), ("s2t", "他出去了", "他出去了"), ("s2t", "戏出了一半", "戲出了一半"),
        ("s2t", "一出戏", "一齣戲"), ("s2t", "三只猫", "三隻貓"), ("s2t", "皇后的头发", "皇后的頭髮"), ("hk2t", "裏面", "裏面"),
    ],
)
def test_cases_that_stand_ins_know(config, text, expected):
    assert configs.resolve(config, REGISTRY).convert(text) == expected


def test_custom_words_against_a_model():
    """Where a dictionary picks wrongly, a custom word and a model both mend it."""
    text = "演员一出戏，导演就喊卡"
    assert configs.resolve("s2t", REGISTRY).convert(text) == "演員一齣戲，導演就喊卡"
    assert configs.resolve("s2t", REGISTRY, [("演员一出戏", "演員一出戲")]).convert(text) == "演員一出戲，導演就喊卡"
    model = arpa.parse("\\2-grams:\n-0.1\t員 出\n-0.9\t員 齣\n-0.1\t這 齣\n")
    registry = Registry(extra={"STPhrases": ["演员\t演員"], "STCharacters": ["出\t出 齣", "这\t這"], "TSCharacters": ["員\t员"], "TSPhrases": []})
    picked = configs.resolve("s2t", registry, model=model, mode="bigram")
    assert picked.convert("演员出") == "演員出" and picked.convert("这出") == "這齣" and configs.resolve("s2t", registry).convert("这出") == "這出"


def test_reports(spark):
    runs = spark.createDataFrame([("a", 10.0, 1.0), ("a", 10.0, 2.0)], "name string, mb double, seconds double")
    assert tools.throughput(runs).collect() == [("a", 7.5, 2.5, 10.0)]
    cases = spark.createDataFrame([("x", "fast", True), ("x", "fast", False), ("x", "bigram", True)], "case string, mode string, passed boolean")
    assert tools.pass_matrix(cases, ["fast", "bigram"]).collect() == [("x", False, True)]
    assert tools.of_bytes("漢字", 7) == "漢字" and tools.of_bytes("漢字", 10) == "漢字漢" and tools.of_bytes("", 5) == ""


def test_markdown(spark):
    page = "<html><body><nav>menu</nav><article><h1>T</h1><p>one  two\u200b</p><ul><li>x</li></ul><aside>no</aside></article>after</body></html>"
    assert tools.page_markdown(page) == "# T\n\none two\n- x" and tools.page_markdown(None) == "" and tools.page_markdown("<main><p>a</p><p>b</p></main>") == "a\n\nb"
    got = spark.createDataFrame([(page,), (None,), ("plain &amp; text",)], "h string").select(tools.markdown("h").alias("m")).collect()
    assert [r["m"] for r in got] == ["# T\n\none two\n- x", "", "plain & text"]


def test_sized_texts(spark):
    from pyspark.sql import functions as F

    rows = ["漢字", "", "aé", "x" * 50, "𠮷"]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", tools.of_bytes_column(F.col("t"), 10).alias("x")).collect()
    assert [r["x"] for r in got] == [tools.of_bytes(t, 10) for t in rows]


def test_sorted_lines_keep_comment_blocks(spark):
    lines = ["# head", "", "# of b", "b\t1", "", "# of a", "# more of a", "a\t2 3", "c\t4", "# tail", ""]
    got = [r["line"] for r in etl.sorted_lines(Registry(extra={"d": lines}).table(spark, "d")).orderBy("line_no").collect()]
    assert got == ["# head", "", "", "# of a", "# more of a", "a\t2 3", "# of b", "b\t1", "c\t4", "# tail", ""]
    assert [r["line"] for r in etl.sorted_lines(Registry(extra={"d": ["# only", ""]}).table(spark, "d")).orderBy("line_no").collect()] == ["# only", ""]


def test_strict_preferences(spark):
    good, bad = ["# @reverse-prefer: x b", "a\tx", "b\tx"], ["# @reverse-prefer: x c", "a\tx"]
    for lines in (good, bad):
        table = Registry(extra={"d": lines}).table(spark, "d")
        loose = listed(etl.reverse(etl.entries(table), etl.preferences(table)))
        assert loose == {"x": ["b", "a"] if lines is good else ["a"]}
        strict = etl.reverse(etl.entries(table), etl.preferences(table), strict=True)
        if lines is good:
            assert listed(strict) == loose
        else:
            with pytest.raises(Exception, match="no mapping for the preference"):
                strict.collect()


def test_library_for_single_texts():
    from glyphflow import api

    assert api.convert("皇后的头发", "s2t", REGISTRY) == "皇后的頭髮" and api.convert_region("萬與", "cn-t", "jp-n", REGISTRY) == "万与"
    assert api.convert_with_custom("买软件", "s2t", {"软件": "軟體"}, REGISTRY) == "買軟體"
    assert api.detect("我買了新的滑鼠很好用", REGISTRY) == ("cn-tw", 40) and api.detect("hello", REGISTRY) is None and api.detect("汉字计算机软件", REGISTRY).region == "cn-s"
    assert api.detect_bytes(b"\xff\xfe\x00", REGISTRY) is None and api.detect_bytes(("汉" * 5000).encode() + b"", REGISTRY) == ("cn-s", 100)
    assert len(api.configs()) == 16 and len(api.regions()) == 6 and api.config_for("cn-s", "cn-tw") == "s2twp"
    with pytest.raises(ValueError):
        api.config_for("cn-s", "jp-n")
    assert "s2t" in repr(api.Converter("s2t", registry=REGISTRY))


def test_dictionaries_from_a_store(spark, tmp_path):
    (tmp_path / "TWVariants.txt").write_text("# c\n裏\t裡\n", encoding="utf-8")
    (tmp_path / "STCharacters.txt").write_text("汉\t漢\n", encoding="utf-8")
    registry = Registry.of_store(spark, f"file://{tmp_path}", extra={"own": ["a\tb"]})
    assert registry.lines("TWVariants")[:2] == ("# c", "裏\t裡") and registry.lines("own") == ("a\tb",) and registry.has("STCharacters") and not registry.has("STPhrases")
    assert configs.resolve("t2tw", registry).convert("裏喫") == "裡喫"
