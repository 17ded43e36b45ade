import io

import pytest

from glyphflow import app
from glyphflow.functions import conversion
from glyphflow.plans import configs
from glyphflow.sources.dictionaries import Registry


def run(spark, *argv, stdin=b""):
    out, err = io.BytesIO(), io.StringIO()
    return app.main(list(argv), spark, io.BytesIO(stdin), out, err), out.getvalue().decode(), err.getvalue()


def test_standard_input(spark):
    assert run(spark, "-c", "jp2t", stdin="弁当\n".encode()) == (0, "辨當\n", "")
    assert run(spark, "--from", "cn-t", "--to", "jp-n", "-", "-", stdin="萬與".encode())[:2] == (0, "万与")
    assert run(spark, "-c", "jp2t", stdin=b"")[:2] == (0, "")
    assert run(spark, "-c", "jp2t", stdin=b"\xff\xfe")[0] == 1


def test_files_folders_and_lists(spark, tmp_path):
    for name, text in (("b.txt", "弁当"), ("d/2.txt", "予備"), ("d/1.txt", "弁護士")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    b, d = str(tmp_path / "b.txt"), str(tmp_path / "d")
    assert run(spark, "-c", "jp2t", d, b, "-", stdin="与".encode())[:2] == (0, "辯護士預備辨當與")
    assert run(spark, "-c", "jp2t", b, "--files-from", "-", "-0", stdin=f"{d}/2.txt\0{b}\0".encode())[:2] == (0, "辨當預備辨當")
    (tmp_path / "own.tsv").write_text("# words\n弁\tX Y\nnothing\n予\t\n")
    assert run(spark, "-c", "jp2t", "--dict", str(tmp_path / "own.tsv"), b)[1] == "X當"
    (tmp_path / "list").write_text(f"{b}\n\n{d}\n")
    lines = run(spark, "detect", "--files-from", str(tmp_path / "list"))
    assert lines[0] == 0 and [x.split("\t")[2] for x in lines[1].splitlines()] == [b, f"{d}/1.txt", f"{d}/2.txt"]
    assert run(spark, "-c", "jp2t", "-o", str(tmp_path / "out"), d)[0] == 0
    assert {r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"辯護士", "預備"}
    assert run(spark, "-c", "jp2t", "-i", b, "-", stdin="与".encode())[:2] == (0, "與") and (tmp_path / "b.txt").read_text() == "辨當"
    assert run(spark, "-c", "jp2t", str(tmp_path / "none"))[0] == 1


def test_stand_ins_and_links(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.txt").write_text("汉字计算机")
    (tmp_path / "a" / "2.txt").write_text("鼠标")
    (tmp_path / "other.txt").write_text("软件")
    (tmp_path / "a" / "3.txt").symlink_to(tmp_path / "other.txt")
    (tmp_path / "a" / "loop").symlink_to(tmp_path / "a")
    assert run(spark, "-c", "s2t", "--stand-ins", str(tmp_path / "a"))[:2] == (0, "漢字計算機鼠標")
    assert run(spark, "-c", "s2t", str(tmp_path / "a"))[0] == 1
    assert [x.split("\t")[2].rsplit("/", 1)[1] for x in run(spark, "detect", str(tmp_path / "a"))[1].splitlines()] == ["1.txt", "2.txt"]
    assert run(spark, "-c", "s2t", "--stand-ins", "-i", str(tmp_path / "a"))[0] == 0
    assert (tmp_path / "a" / "1.txt").read_text() == "漢字計算機" and (tmp_path / "other.txt").read_text() == "软件"


def test_detect(spark, tmp_path):
    code, out, err = run(spark, "detect", str(tmp_path / "none"), "-", stdin="他感染了A型肝炎".encode())
    assert (code, out) == (1, "cn-tw\t50\t-\n") and "none" in err
    assert run(spark, "detect", stdin=b"\xff") == (0, "unknown\t0\t-\n", "")


def test_auto(spark, tmp_path):
    assert run(spark, "--auto", "--target", "cn-t", stdin="これは弁当".encode())[:2] == (0, "これは辨當")
    assert run(spark, "--auto", stdin=b"plain")[:2] == (0, "plain")
    code, _, err = run(spark, "--auto", "--target", "cn-hk", stdin="これは弁当".encode())
    assert code == 1 and err


def test_ngram_modes(spark, tmp_path):
    model = tmp_path / "m.arpa"
    model.write_text("\\2-grams:\n-0.1\t与 弁\n-0.5\t与 辯\n")
    assert run(spark, "-c", "jp2t", "--bigram", stdin=b"x")[0] == 1
    assert run(spark, "-c", "jp2t", "--ngram", str(model), "--fast", stdin="弁当".encode())[1] == "辨當"
    assert run(spark, "-c", "jp2t", "--ngram", str(model), "--bigram", stdin="弁当".encode())[0] == 0


@pytest.mark.parametrize(
    "argv",
    [["--from", "cn-s"], ["--target", "cn-t"], ["--auto", "--target", "cn-t", "--from", "cn-s", "--to", "cn-t"], ["-c", "s2t", "--from", "cn-s", "--to", "cn-t"], ["--what"], ["info"], ["info", "x"], ["-c", "x"], ["-c", "s2t"]],
)
def test_refused(spark, argv):
    code, out, err = run(spark, *argv)
    assert (code, out) == (1, "") and err


def test_information(spark):
    code, out, _ = run(spark, "--list")
    assert code == 0 and out.count("\n") == len(configs.REGIONS) + len(configs.PAIRS) + 3
    assert "辨當" in run(spark, "info", "jp2t")[1] and "needs: TSPhrases, STPhrases, STCharacters" in run(spark, "info", "s2t")[1]


def test_inline_config_and_auto_routes(spark):
    plan = configs.resolve_json('{"conversion_chain": [{"dict": {"type": "inline", "entries": {"a b": "X Y", "c": ["Z", "W"]}}}]}')
    assert plan.chain[0].layers[0].values == {"a b": "X", "c": "Z"}
    registry = Registry(extra={"STPhrases": [], "STCharacters": ["万\t萬"], "TSCharacters": ["萬\t万", "與\t与", "當\t当"], "TSPhrases": []})
    rows = spark.createDataFrame([(0, "これは弁当"), (1, "萬與"), (2, "abc"), (3, None)], "id int, t string")
    got = {r["id"]: r["x"] for r in rows.select("id", conversion.convert_auto("t", "cn-s", registry).alias("x")).collect()}
    assert got == {0: "これは辨当", 1: "万与", 2: "abc", 3: None}
