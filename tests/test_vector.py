"""Whole batches against the plain definitions, one text at a time."""

import pickle
import random
import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphflow.functions import conversion, detection
from glyphflow.operators import matching, vector
from glyphflow.plans import configs, texts
from glyphflow.plans.configs import Plan
from glyphflow.plans.queries import REGISTRY

ALPHABET = "ab汉字𠮷c，\U00031350\U0010fffd"


def word(draw, least, most):
    return "".join(draw.choice(ALPHABET) for _ in range(draw.randint(least, most)))


def layer(draw, single):
    out = matching.Layer()
    for _ in range(draw.randint(0, 8)):
        out.add(word(draw, 1 if single else 2, 4), [word(draw, 0 if draw.random() < 0.1 else 1, 3) for _ in range(draw.randint(1, 2))])
    return out


def without_singles(group):
    some = lambda d: {k: v for k, v in d.items() if len(k) > 1}
    return matching.Group([matching.Layer(some(x.values), some(x.candidates)) for x in group.layers])


@pytest.mark.parametrize("seed", range(4))
def test_random_plans(seed):
    """Layers, stages, segmentation, ASCII keys, empty and longer values, astral characters, nulls, slices."""
    draw, fused = random.Random(seed), 0
    for n in range(500):
        chain = [matching.Group([layer(draw, draw.random() < 0.7) for _ in range(draw.randint(1, 3))]) for _ in range(draw.randint(1, 3))]
        segmentation = draw.choice([None, matching.Group([layer(draw, True)]), without_singles(chain[0])])
        plan = Plan(segmentation, chain)
        compiled = vector.Compiled(plan)
        compiled = pickle.loads(pickle.dumps(compiled)) if n % 5 == 0 else compiled
        fused += compiled.fused
        rows = [draw.choice([None, "", word(draw, 1, 30), word(draw, 5, 60)]) for _ in range(draw.randint(0, 6))]
        array = pa.array([*rows, "x"], pa.string()).slice(0, len(rows))
        assert compiled.convert(array).to_pylist() == [None if t is None else plan.convert(t) for t in rows]
        plain = lambda t: matching.segments(segmentation, t) if segmentation else [(t, False)] if t else []
        want = [None if t is None else [{"seg_no": k, "seg": s, "matched": m} for k, (s, m) in enumerate(plain(t))] for t in rows]
        assert compiled.segments(array).to_pylist() == want
    assert fused > 20


@pytest.mark.parametrize("seed", range(3))
def test_random_models(seed):
    """Picks by bigrams, in both modes, with candidates of one and of several lengths, in one and in several stages."""
    draw, served = random.Random(seed), 0
    for _ in range(400):
        model = matching.Ngrams()
        for _ in range(draw.randint(0, 40)):
            model.orders[2][draw.choice(["<s>", word(draw, 1, 1), word(draw, 1, 3)]), word(draw, 1, 1)] = -draw.random()
        chain = []
        for _ in range(draw.choice([1, 1, 1, 2])):
            one, even = matching.Layer(), draw.random() < 0.7
            for _ in range(draw.randint(1, 9)):
                key = word(draw, 1, 3)
                n = len(key) if even else draw.randint(1, 3)
                one.add(key, [word(draw, n, n) for _ in range(draw.randint(1, 6))])
            chain.append(matching.Group([one]))
        plan = Plan(draw.choice([None, without_singles(chain[0])]), chain, model, draw.choice(["bigram", "trigram"]))
        compiled = vector.Compiled(plan)
        served += compiled.picking is not None
        rows = [draw.choice([None, "", word(draw, 1, 40)]) for _ in range(5)]
        assert compiled.convert(pa.array(rows, pa.string())).to_pylist() == [t and plan.convert(t) for t in rows]
    assert served > 100


@pytest.mark.parametrize("mode", ["bigram", "trigram"])
def test_picks_that_hang_on_picks(mode):
    """Chains of every length, <s> as text and as no whole character, NUL, ASCII and astral contexts."""
    draw = random.Random(mode)
    model = matching.Ngrams()
    for before, c in [("甲", "乙"), ("乙", "甲"), ("<s>", "乙"), ("甲乙", "乙"), ("乙甲", "甲"), ("a", "乙"), ("ab", "甲"), ("\0", "乙"), ("é", "乙"), ("𠮷", "乙"), ("ééé", "乙"), ("x甲", "甲")]:
        model.orders[2][before, c] = -draw.random()
    plan = Plan(None, [matching.Group([matching.layer_of(["丙\t甲 乙", "丁\t乙 甲", "丁丁戊\t甲甲甲 乙乙甲"])])], model, mode)
    compiled = vector.Compiled(plan)
    rows = ["丙" * 700, "丁" * 33 + "<s>丙" * 9, "𠮷丙" * 20, *("".join(draw.choices("丙丁戊甲乙aébx\0𠮷", weights=[9, 9, *[1] * 9], k=draw.randint(1, 200))) for _ in range(200)), *("".join(draw.choices(["<s>", "丙", "丁", "ab", "x甲"], k=9)) for _ in range(99))]
    assert compiled.picking is not None and compiled.convert(pa.array(rows)).to_pylist() == [plan.convert(t) for t in rows]


def test_picks_are_not_gone_through_one_by_one(monkeypatch):
    """The model is asked when a plan is compiled, not while texts are converted; few rounds decide the registered queries' texts."""
    from glyphflow.plans import queries
    from glyphflow.sources import arpa

    for mode in ("bigram", "trigram"):
        compiled = vector.Compiled(configs.resolve_json('{"conversion_chain": [{"dict": {"type": "text", "file": "own.txt"}}]}', configs.Registry(extra={"own": queries._NGRAM_DICT}), model=arpa.parse(queries.ARPA), mode=mode))
        rows, rounds = ["与弁麺台煙演国出" * 3000], []
        want = [compiled.plan.convert(t) for t in rows]
        real = vector.Picking._picked
        monkeypatch.setattr(vector.Picking, "_picked", lambda *a: rounds.append(1) or real(*a))
        monkeypatch.setattr(matching.Ngrams, "pick", None)
        assert compiled.convert(pa.array(rows)).to_pylist() == want and len(rounds) <= vector._ROUNDS
        monkeypatch.undo()


def test_only_what_may_differ_is_looked_up(monkeypatch):
    """No context is put together where none of a pick's own can end, and single characters aren't gone through to tell which matches are taken."""
    from glyphflow.plans import queries
    from glyphflow.sources import arpa

    source = '{"segmentation": {"dict": {"type": "inline", "entries": {"国弁": "國辯"}}}, "conversion_chain": [{"dict": {"type": "text", "file": "own.txt"}}]}'
    real, lengths = vector.leftmost, []
    monkeypatch.setattr(vector, "leftmost", lambda position, length: lengths.extend(length.tolist()) or real(position, length))
    for mode in ("bigram", "trigram"):
        compiled = vector.Compiled(configs.resolve_json(source, configs.Registry(extra={"own": queries._NGRAM_DICT}), model=arpa.parse(queries.ARPA), mode=mode))
        rows = ["的弁麺床，出国国弁弁麺台" * 50, "与弁"]
        assert compiled.convert(pa.array(rows)).to_pylist() == [compiled.plan.convert(t) for t in rows]
        rows = ["的弁麺出，麺床弁" * 50, "演弁", "b出"]
        with monkeypatch.context() as without:
            without.setattr(vector, "_bytes_of", None)
            assert compiled.convert(pa.array(rows)).to_pylist() == [compiled.plan.convert(t) for t in rows]
    assert lengths and min(lengths) > 1


@pytest.mark.parametrize("config", ["s2hk", "tw2sp"])
def test_a_batch_is_not_held_in_parts(config, monkeypatch):
    """While a part is converted, those before it are gone; values that are longer than the keys grow the one array that is kept."""
    plan = configs.resolve(config, REGISTRY, [("爲", "因為什麼" * 40)])
    compiled, made, alive = vector.Compiled(plan), [], []
    real = vector.Compiled._part

    def part(self, texts):
        alive.append(sum(r() is not None for r in made))
        out = real(self, texts)
        made.append(weakref.ref(out))
        return out

    monkeypatch.setattr(vector, "CHARS", 200)
    monkeypatch.setattr(vector.Compiled, "_part", part)
    rows = [None, *texts.SEEDS, None, "", "爲" * 300, *texts.SEEDS * 20]
    for kind in (pa.string(), pa.large_string()):
        assert compiled.convert(pa.array(rows, kind)).to_pylist() == [t and plan.convert(t) for t in rows]
    assert len(made) > 20 and max(alive) <= 1
    assert compiled.convert(pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("config", list(configs.CONFIGS))
def test_configs_in_parts(config, monkeypatch):
    """All 16 pipelines over mixed texts, also cut into small parts and beyond the length for arrays."""
    draw = random.Random(config)
    words = [k for g in configs.resolve(config, REGISTRY).chain for x in g.layers for k in x.values]
    rows = [None, "", *texts.SEEDS, *("".join(draw.choice([*draw.choices(words, k=8), *"a ，。1"]) for _ in range(draw.randint(0, 60))) for _ in range(120))]
    plan = configs.resolve(config, REGISTRY)
    compiled, want = vector.Compiled(plan), [None if t is None else plan.convert(t) for t in rows]
    assert compiled.convert(pa.array(rows, pa.string())).to_pylist() == want
    monkeypatch.setattr(vector, "CHARS", 64)
    assert compiled.convert(pa.array(rows, pa.string())).to_pylist() == want
    assert compiled.convert(pa.array(rows, pa.large_string())).to_pylist() == want
    monkeypatch.setattr(vector, "ROWS", 3)
    assert compiled.convert(pa.array(rows, pa.string())).to_pylist() == want
    monkeypatch.setattr(vector, "CHARS", 1)
    assert compiled.convert(pa.array(rows, pa.string())).to_pylist() == want


def test_ascii_stays():
    """Texts of ASCII alone, few or many among others, nulls among them; with a model they are looked up."""
    plan = configs.resolve("s2twp", REGISTRY, [("SQL", "x"), ("a", "b")])
    compiled = vector.Compiled(plan)
    for rows in (["SQL a"] * 5, ["SQL a", None, "SQL注入 a", "皇后SQL", ""], ["皇后", "a"], [None], ["a", None, "b", "后a", "c", "d"]):
        for kind in (pa.string(), pa.large_string()):
            assert compiled.convert(pa.array(rows, kind)).to_pylist() == [t and plan.convert(t) for t in rows]
    model = matching.Ngrams()
    plan = Plan(None, [matching.Group([matching.layer_of(["a\tb c"])])], model, "bigram")
    assert vector.Compiled(plan).convert(pa.array(["xa"])).to_pylist() == [plan.convert("xa")] == ["xb"]


def test_a_hash_that_lies_changes_nothing(monkeypatch):
    """Where a hash is met without its key's characters, texts are walked one by one."""
    plan = configs.resolve("s2t", REGISTRY)
    compiled, rows = vector.Compiled(plan), ["皇后头发干部", "里面的台风", None, "abc"]
    index = compiled.stages[0].index
    pairs = [k for k in index.key.tolist() if k >= 0 and index.keys.length[k] == 2]
    index.key[[k in pairs for k in index.key.tolist()]] = [*pairs[1:], pairs[0]]  # every key of two characters now stands for another one
    with pytest.raises(vector.HashCollision):
        compiled.batch(vector.batch_of(pa.array(rows[:2])))
    assert compiled.convert(pa.array(rows)).to_pylist() == [t and plan.convert(t) for t in rows]


def test_detection_in_batches(spark):
    """Arrow batches, Catalyst expressions and the SQL function agree, whatever scripts meet."""
    draw = random.Random(2)
    pool = [*texts.SEEDS, "汉字", "説話", "の", "ア", "ab", "爲", "軟體", "寬頻", "伺服器", "資料夾", "発", "𠮷"]
    rows = [(k, draw.choice([None, ""]) if k < 4 else "".join(draw.choices(pool, k=draw.randint(1, 4)))) for k in range(400)]
    df = spark.createDataFrame(rows, "id int, t string").repartition(3)
    both = df.select("id", "t", detection.detect("t", REGISTRY).alias("a"), detection.detect("t", REGISTRY, strategy="catalyst").alias("c")).collect()
    assert all(r["a"] == r["c"] for r in both) and {r["a"]["region"] for r in both if r["a"]} >= {"cn-s", "cn-t", "cn-tw", "cn-hk", "jp-n"}
    conversion.register(spark, REGISTRY)
    df.createOrReplaceTempView("mixed_texts")
    named = spark.sql("select id, hz_detect(t) d, hz_s2t(t) s, hz_segments_of(t, if(id % 2 = 0, 's2t', 't2jp')) g from mixed_texts").collect()
    by_id = {r["id"]: r["a"] for r in both}
    plans = {c: configs.resolve(c, REGISTRY) for c in ("s2t", "t2jp")}
    text = dict(rows)
    for r in named:
        t = text[r["id"]]
        assert r["d"] == by_id[r["id"]] and r["s"] == (None if t is None else plans["s2t"].convert(t))
        assert t is None or "".join(x["seg"] for x in r["g"]) == t
    assert spark.sql("select seg, matched from hz_segments('皇后的头发', 's2t')").collect() == [("皇后", True), ("的", False), ("头发", True)]


def test_routing_in_one_function(spark):
    """convert_auto equals each text's own way, and a missing way is an error unless permitted."""
    rows = [(k, t) for k, t in enumerate([*texts.SEEDS, None])]
    df = spark.createDataFrame(rows, "id int, t string").repartition(2)
    got = {r["id"]: r["x"] for r in df.select("id", conversion.convert_auto("t", "cn-s", REGISTRY).alias("x")).collect()}
    found = {r["id"]: r["d"] and r["d"]["region"] for r in df.select("id", detection.detect("t", REGISTRY).alias("d")).collect()}
    for k, t in rows:
        for config in configs.route(found[k], "cn-s"):
            t = configs.resolve(config, REGISTRY).convert(t)
        assert got[k] == t
    with pytest.raises(Exception, match="no conversion from"):
        df.select(conversion.convert_auto("t", "cn-hk", REGISTRY)).collect()
    kept = df.select("t", conversion.convert_auto("t", "cn-hk", REGISTRY, permissive=True).alias("x")).collect()
    assert all(r["t"] == r["x"] for r in kept)


def test_long_text_is_walked(monkeypatch):
    compiled, text = vector.Compiled(configs.resolve("s2t", REGISTRY)), "皇后的头发" * 50_000
    want = compiled.convert(pa.array([text, None])).to_pylist()
    assert want == ["皇后的頭髮" * 50_000, None]
    monkeypatch.setattr(vector, "LONG", 1000)
    monkeypatch.setattr(vector, "strings_of", None)
    assert compiled.convert(pa.array([text, None])).to_pylist() == want
    assert "".join(x["seg"] for x in compiled.segments(pa.array([text]))[0].as_py()) == text
