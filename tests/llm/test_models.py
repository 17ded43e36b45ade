"""The trained operators: what EM, the span classifier, the ranking and the centroids learn, against plain versions."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import language_id, pii, quality


def test_em_recovers_reliabilities():
    """Votes drawn from known reliabilities, with abstentions: EM finds them and the class share again."""
    draw = np.random.default_rng(3)
    right = np.array([[0.7, 0.8], [0.9, 0.95], [0.85, 0.6], [0.9, 0.9], [0.75, 0.9]])  # by labeler and class
    counts = {}
    for _ in range(40_000):
        y = int(draw.random() < 0.35)
        vote = tuple(int(draw.random() < 0.8) * (1 if (draw.random() < right[k, y]) == (y == 1) else -1) for k in range(5))
        counts["phone", vote] = counts.get(("phone", vote), 0) + 1
    reliability, prior = pii.em(counts, rounds=200)
    assert abs(prior["phone"] - 0.35) < 0.03 and np.abs(np.stack([reliability[:, 0, 0], reliability[:, 1, 2]], axis=1) - right).max() < 0.04


def test_em_step_against_enumeration():
    """One E step by the formula, term by term, is what posterior() gives."""
    draw = np.random.default_rng(1)
    yes = draw.random((5, 2))
    reliability = np.stack([1 - yes, np.ones((5, 2)), yes], axis=2)
    for vote in itertools.islice(itertools.product((-1, 0, 1), repeat=5), 0, None, 7):
        p1 = 0.3 * math.prod(reliability[k, 1, v + 1] for k, v in enumerate(vote))
        p0 = 0.7 * math.prod(reliability[k, 0, v + 1] for k, v in enumerate(vote))
        assert abs(pii.posterior(reliability, 0.3, vote) - p1 / (p0 + p1)) < 1e-9


def test_wider_spans_are_accepted_and_rejected(spark):
    """A national number after 'call' is added, a build number of the same shape isn't; base spans stay."""
    good = [f"please call ({200 + k % 700}) 555-{1000 + k} today, mail me{k}@site{k}.org" for k in range(300)]
    bad = [f"see build {200 + k % 700}.555.{1000 + k}x of the manual" for k in range(300)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*good, *bad])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    added = [[x for x in got[k]["spans"].split(",") if x.startswith("phone")] for k in range(600)]
    assert sum(map(len, added[:300])) >= 290 and sum(map(len, added[300:])) <= 10
    assert all(got[k]["n_email"] == 1 and f"email:{good[k].index('me' + str(k))}" in got[k]["spans"] for k in range(300))
    out = {r["doc_id"]: r["text"] for r in pii.redacted(df).collect()}
    assert out[0] == "please call [PHONE] today, mail [EMAIL]" and out[300] == bad[0]


def test_spans_of_one_text_take_linear_time():
    def took(n):
        text = " ".join(f"({200 + k % 700}) 555-{1000 + k % 9000} a{k}@b.org 10.0.{k % 256}.1 token = abcdef{k:012d}xyz" for k in range(n))
        began = time.process_time()
        found = pii.candidates(text)
        assert len(found) >= 4 * n
        return time.process_time() - began

    assert took(8_000) < 1 + 9 * took(2_000)


def test_taken_against_all_pairs():
    draw = np.random.default_rng(2)
    spans = [(int(s), int(s + n)) for s, n in zip(draw.integers(0, 300, 25), draw.integers(1, 12, 25), strict=True)]
    taken, plain = pii.Taken(spans), list(spans)
    for s, n in zip(draw.integers(0, 320, 300).tolist(), draw.integers(1, 6, 300).tolist(), strict=True):
        free = not any(a < s + n and s < b for a, b in plain)
        assert taken.free(s, s + n) == free
        if free:
            taken.add(s, s + n)
            plain.append((s, s + n))


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, None, 5, "x"), (2, "", 0, "y"), (2, "", 0, "y"), (None, "a@b.org " * 3, 9, "z"), (4, "a@b.org", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, found string")
    got = sorted(map(tuple, pii.redacted(df).collect()), key=str)
    assert got == sorted([(1, None, None, "x"), (2, "", 0, "y"), (2, "", 0, "y"), (None, "[EMAIL] " * 3, 24, "z"), (4, "[EMAIL]", 7, None)], key=str)
    assert pii.redacted(df.limit(0)).count() == 0


def test_ranking_against_plain_gradient_steps():
    """Newton's weights are where the gradient of the pairwise logistic loss vanishes, and equal slow descent's."""
    draw = np.random.default_rng(4)
    x = draw.standard_normal((200, quality.N_FEATURES)) * (np.arange(quality.N_FEATURES) < 3)
    y = (x[:, 0] + 0.5 * draw.standard_normal(200) > 0).astype(int)
    model = quality.train(x, y, pairs=2_000, seed=7)
    z = quality.standardised(x, model.mean, model.scale)
    order = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[order.choice(good, 2_000)] - z[order.choice(bad, 2_000)]
    w = np.zeros(quality.N_FEATURES)
    for _ in range(6_000):
        w -= 0.3 * (-(d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(axis=0) + quality.RIDGE * w)
    assert np.abs(model.weights - w).max() < 1e-3


def test_threshold_against_all_cuts():
    draw = np.random.default_rng(6)
    s, y = draw.standard_normal(80), draw.integers(0, 2, 80)
    s[y == 1] += 1
    model = quality.Model(np.zeros(1), np.ones(1), np.zeros(1), s, y)
    quantiles = np.quantile(s, np.arange(1, 40) / 40).tolist()
    cut = quality.threshold(model, quantiles)
    gain = lambda q: ((s >= q) & (y == 1)).sum() / (y == 1).sum() + ((s < q) & (y == 0)).sum() / (y == 0).sum()
    assert gain(cut) >= max(gain((a + b) / 2) for a, b in itertools.pairwise(sorted(quantiles))) - 1e-9


def _prose(k, words, n=40):
    draw = np.random.default_rng(k)
    return " ".join(draw.choice(words, n)).capitalize() + "."


ENGLISH = "the of and to in is that it was for on are with as his they at be this from".split()
FRENCH = "le de la et les des en un une que est pour qui dans du sur pas plus au ne".split()


def test_quality_held_out_and_odd_rows(spark):
    """Held-out accuracy, null ids, repeated ids, long texts and repeated rows."""
    rows = [(k, _prose(k, ENGLISH) if k % 2 else f"{_prose(k, ENGLISH)} CLICK!!! $$$ {k} ###" * 2, k % 2) for k in range(400)]
    docs = spark.createDataFrame([(k, t, y) for k, t, y in rows] + [(None, "no id", 1), (None, None, 0), (7, _prose(7, ENGLISH), 0), (7, "BUY!!! NOW### $$$", 0), (900, _prose(1, ENGLISH, 60_000), 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).withColumn("h", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["h"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 60 and all(r["predicted"] == r["doc_id"] % 2 for r in held if r["doc_id"] != 7)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    raw = {t: model.raw(t) for _, t, _ in rows[:20]}
    assert all(abs(raw[t] - float(np.clip((quality.features(t) - model.mean) / model.scale, -8, 8) @ model.weights)) < 1e-12 for t in raw)


def test_language_against_brute_force(spark):
    """classify() is the language of the largest cosine over all centroids, ties to the first; repeated rows agree."""
    rows = [(k, _prose(k, ENGLISH if k % 2 else FRENCH), "en" if k % 2 else "fr", 1) for k in range(120)]
    rows += [(200, "", "en", 1), (201, "123 456", "fr", 1), (202, None, "en", 1), (None, rows[0][1], "fr", 1), (5, rows[5][1], "en", 1), (203, _prose(1, ENGLISH, 80_000), None, 1), (204, "Ωωω ψψψ", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, rejected int")
    model = language_id.fit(df)
    for r in language_id.classify(df, model).collect():
        text = next(t for k, t, _, _ in rows if k == r["doc_id"])
        if not language_id.has_letter(text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        v = language_id.ngram_counts(text) * model.idf
        cosines = [(float(c @ v / np.sqrt(v @ v)), -k) for k, c in enumerate(model.centroids)]
        best, k = max(cosines)
        language = model.languages[model.owner[-k]]
        assert r["lang_pred"] == language and abs(r["score"] - best) < 1e-5 and r["rejected"] == (r["score"] < model.reach[model.languages.index(language), language_id.band_of(language_id.ngram_counts(text))])
    held = [r for r in language_id.classify(df.where("doc_id < 200"), model).withColumn("h", language_id.held_out(F.col("doc_id"))).collect() if r["h"]]
    assert len(held) > 15 and all(r["lang_pred"] == ("en" if r["doc_id"] % 2 else "fr") for r in held)


def test_other_scripts_and_noise_are_rejected():
    """Other alphabets, random letters and encoded bytes lie beyond reach; short and long texts of the languages don't."""
    texts = [(_prose(k, words, n), lang) for lang, words in (("en", ENGLISH), ("fr", FRENCH)) for n in (6, 20, 80, 400) for k in range(40)]
    model = language_id.train(np.stack([language_id.ngram_counts(t) for t, _ in texts]), [lang for _, lang in texts])
    draw = np.random.default_rng(5)
    noise = " ".join("".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), draw.integers(2, 9))) for _ in range(200))
    assert all(model.predict(t)[2] for t in (noise, "Все счастливые семьи похожи друг на друга", "裏面純喫茶喫飯", "zxqj wvkp qqzx jjwv " * 30))
    assert not any(model.predict(_prose(100 + k, words, n))[2] for words in (ENGLISH, FRENCH) for n in (6, 20, 80, 400) for k in range(20))


def test_no_language_is_left_out(spark):
    """Many languages: each one that has a labelled row is learned."""
    alphabet = [chr(0x4E00 + k) for k in range(300)]
    rows = [(4 * k + j, (alphabet[k] + "ab" + alphabet[k]) * 5, f"l{k:03d}") for k in range(300) for j in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    with_rows = {r["lang"] for r in df.where(~language_id.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert set(language_id.fit(df).languages) == with_rows and len(with_rows) > 256


def test_fit_in_tasks_equals_fit_at_hand(spark):
    rows = [(k, _prose(k, ENGLISH if k % 2 else FRENCH), "en" if k % 2 else "fr") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    used = {r["doc_id"] for r in df.where(~language_id.held_out(F.col("doc_id"))).collect()}
    got = sorted((lang, language_id.ngram_counts(t).astype(np.float32).tobytes()) for k, t, lang in rows if k in used)
    plain = language_id.train(np.stack([np.frombuffer(v, np.float32) for _, v in got]).astype(float), [lang for lang, _ in got])
    assert model.languages == plain.languages and np.allclose(model.centroids, plain.centroids, atol=1e-6) and np.allclose(model.reach, plain.reach)


@pytest.mark.parametrize("text", ["", "a", "ab", " \n ", "é" * 3, "x" * 50_000])
def test_features_of_odd_texts(text):
    assert np.isfinite(quality.features(text)).all() and np.isfinite(language_id.ngram_counts(text)).all()
