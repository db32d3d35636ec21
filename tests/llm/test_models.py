"""Language ID, quality classifier and mixing: held-out accuracy, edges, and checks by hand."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import language_id, mixing, quality_classifier

DOCS = "doc_id long, text string, lang string, lang_pred string, SCORE string, n_tokens string, rate string"


def docs(spark, *rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], DOCS)


SYLLABLES = {"aa": ["ka", "ro", "mi", "tu"], "bb": ["schl", "ung", "ber", "heit"], "cc": ["éa", "ção", "nh", "lh"]}


def speech(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def corpus(n=30):
    return [(k * 100 + i, speech(lang, i), lang) for k, lang in enumerate(SYLLABLES) for i in range(n)]


# -- language ---------------------------------------------------------------------


def test_language_and_edges(spark):
    model = language_id.learn(docs(spark, *corpus(), (900, None, "aa"), (901, speech("bb", 0), None)))
    assert model.languages == ["aa", "bb", "cc"]
    rows = [(i, speech(x, f"new{i}"), x) for i, x in enumerate([*SYLLABLES] * 4)]
    odd = [None, "", "12 !? \n", "…—。", "漢字", "Ж", "x", speech("aa", 3).upper(), speech("cc", 5, 30_000)]
    got = language_id.predict(docs(spark, *rows, *[(100 + i, t, None) for i, t in enumerate(odd)]), model)
    assert got.columns == ["doc_id", "text", "lang", "n_tokens", "rate", "lang_pred", "score"]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert all(found[i][0] == x and found[i][1] > 0.8 for i, _, x in rows)
    assert [found[100 + i] for i in range(4)] == [("und", 0.0)] * 4
    assert all(found[100 + i] == (model.languages[model.usual], 0.0) for i in (4, 5, 6))
    assert found[107][0] == "aa" and found[108][0] == "cc"
    assert language_id.predict(docs(spark).limit(0), model).count() == 0


def test_nothing_to_learn_a_language_from(spark):
    model = language_id.learn(docs(spark, (1, "text", None)))
    assert language_id.predict(docs(spark, (1, "text", None)), model).first()["lang_pred"] == "und"


def test_many_languages_and_a_bounded_sample(spark):
    rows = [(i, f"{chr(0x4E00 + 7 * i) * 6} {chr(0x4E00 + 7 * i) * 5}", f"l{i:03d}") for i in range(130) for _ in range(2)]
    model = language_id.learn(docs(spark, *rows))
    assert len(model.slots) == 3
    got = language_id.predict(docs(spark, *rows), model).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    few = language_id.learn(docs(spark, *corpus(60)), max_rows=30)
    assert few.fill.max() <= model.fill.max() or few.languages
    answers = language_id.predict(docs(spark, *corpus(5)), few).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in answers) >= 10


def test_copies_of_a_text_are_learned_from_once(spark, monkeypatch):
    learned = []
    counts = language_id._gram_counts
    monkeypatch.setattr(language_id, "_gram_counts", lambda texts: learned.append(texts) or counts(texts))
    copies = [(10_000 + i, speech("aa", "copied"), "aa") for i in range(200)]
    model = language_id.learn(docs(spark, *corpus(), *copies))
    plain = language_id.learn(docs(spark, *corpus(), copies[0]))
    assert [t.count() for t in learned] == [91, 91]
    assert (model.fill == plain.fill).all() and all((a == b).all() for a, b in zip(model.slots, plain.slots, strict=True))


def test_false_positives_are_taken_off():
    full = np.ones(1 << language_id.SLOT_BITS, np.uint8)
    model = language_id.LanguageFilter(["aa", "bb"], [full], np.array([1.0, 0.0]), 0)
    data = np.frombuffer(b" abcdef   ", np.uint8)
    shares, _ = language_id.text_scores(model, data, np.array([0, len(data)]))
    assert shares[0].tolist() == [0.0, 0.0]  # a full filter tells nothing


def test_held_out_languages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from wordloom.llm.queries import op7_language_id

    got = op7_language_id(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.collect())
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


# -- quality ----------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    features = rng.normal(size=(9, quality_classifier.FEATURES))
    before, labels = np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality_classifier.fit(features, before, labels, epochs=1)

    def loss():
        p = quality_classifier._sigmoid(model.forward(features, before)["logit"])
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    run = model.forward(features, before)
    found = model.gradients(run, before, (quality_classifier._sigmoid(run["logit"]) - labels) / 3)
    for name, weight in model.weights.items():
        for at in [np.unravel_index(k, weight.shape) for k in rng.integers(0, max(1, weight.size), 4)]:
            old = weight[at].copy()
            weight[at] = old + 1e-5
            up = loss()
            weight[at] = old - 1e-5
            down = loss()
            weight[at] = old
            assert found[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_features_by_hand():
    texts = [b"", b"Aa 1! Aa Aa " + b"x " * 70, "é#".encode(), b"   "]
    data = np.frombuffer(b"".join(texts), np.uint8)
    features, before = quality_classifier.encode(data, np.cumsum([0, *map(len, texts)]))
    assert before.tolist() == [0, 1, 3, 4, 5]
    assert not features[0].any() and not features[4].any()
    kinds = features[1, quality_classifier.PAIRS :]
    letters = 8 + 60
    assert kinds[:5] == pytest.approx([63 / letters, 3 / letters, 1 / letters, 0, 1 / letters])
    assert kinds[-4:-1] == pytest.approx([(1 + 59) / 64, 3 / 64, 1.0])
    assert features[3, quality_classifier.PAIRS + 3] == pytest.approx(1 / 3)


def test_quality_of_held_out_bags(spark):
    rows, labels = [], []
    for i in range(300):
        good = " ".join(speech("aa", f"{i}-{k}") for k in range(3))
        bad = good + " " + " ".join(f"#{w}$$" for w in speech("bb", i, 90).split())
        rows.append((i, bad if i % 3 == 0 else good, None))
        labels.append((i, int(i % 3 != 0)))
    table = spark.createDataFrame([*labels[:200], labels[0], (5000, 1), (0, None)], "doc_id long, quality int")
    model = quality_classifier.learn(docs(spark, *rows), table)
    got = quality_classifier.score(docs(spark, *rows, (400, None, None), (401, "", None), (402, "w " * 200_000, None)), model)
    found = {r["doc_id"]: r["score"] for r in got.collect()}
    assert "SCORE" not in got.columns and len(found) == 303
    assert all(0 <= s <= 1 for s in found.values()) and found[400] == pytest.approx(found[401])
    assert np.mean([(found[i] >= 0.5) == bool(y) for i, y in labels[200:]]) > 0.95


def test_nothing_to_learn_quality_from(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.learn(docs(spark, (1, "a", None)), none)
    assert quality_classifier.score(docs(spark, (1, "a b", None)), model).first()["score"] == 0.5


# -- mixing -----------------------------------------------------------------------

TARGETS = {"aa": 0.2, "bb": 0.5, "cc": 0.3}


def test_mixing_meets_targets(spark):
    rows = corpus(40) + [(900 + i, speech("aa", f"m{i}") + " " + speech("bb", f"m{i}"), None) for i in range(20)]
    rows += [(950, None, None), (951, "", None), (952, speech("aa", "long", 20_000), "aa"), (0, *rows[0][1:])]
    table = docs(spark, *rows)
    got = mixing.mix_documents(table, table, TARGETS, domain="lang", keep=("doc_id", "lang")).collect()
    assert len(got) == len(rows)
    tokens = np.array([r["n_tokens"] for r in got], float)
    assert sorted(tokens) == sorted(len((t or "").split()) for _, t, _ in rows)
    soft, rate = np.array([r["posterior"] for r in got]), np.array([r["rate"] for r in got])
    assert (rate >= 0).all() and np.allclose(soft.sum(axis=1), 1)
    share = (soft * (rate * tokens)[:, None]).sum(axis=0) / tokens.sum()
    assert share == pytest.approx([0.2, 0.5, 0.3], abs=1e-4)
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in got)
    assert {x["domain"] for x in got[0]["residual"]} == set(TARGETS)
    assert all(abs(x["tokens"]) < 1e-3 * tokens.sum() for r in got for x in r["residual"])
    mixed = [max(r["posterior"]) for r in got if 900 <= r["doc_id"] < 920]
    assert np.mean(mixed) < np.mean([max(r["posterior"]) for r in got if r["doc_id"] < 300])


def test_mixing_edges(spark):
    table = docs(spark, *corpus(3))
    alone = mixing.mix_documents(table, table.where("lang is null"), TARGETS, domain="lang", budget=2.0)
    assert {r["rate"] for r in alone.collect()} == {2.0}
    unmet = mixing.mix_documents(table, table, {"zz": 1.0}, domain="lang").collect()
    assert all(r["rate"] >= 0 for r in unmet) and sum(r["rate"] for r in unmet) < 1e-3
    left = {x["domain"]: x["tokens"] for x in unmet[0]["residual"]}
    assert left["zz"] == -sum(r["n_tokens"] for r in unmet) and set(left) == {"aa", "bb", "cc", "zz"}
    assert mixing.mix_documents(table.limit(0), table, TARGETS, domain="lang").count() == 0


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(4)
    soft = rng.dirichlet([0.5, 0.5, 0.5], 50)
    tokens = rng.integers(1, 100, 50)
    members = spark.createDataFrame(
        [(int(n), [float(x) for x in p]) for n, p in zip(tokens, soft, strict=True)], "n_tokens long, posterior array<double>")
    rate, expected, target = mixing.fit_rates(members, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1}, steps=40)
    rates = np.array([r[0] for r in members.select(F.col("n_tokens"), rate.alias("r")).select("r").collect()])
    assert (soft * (rates * tokens)[:, None]).sum(axis=0) == pytest.approx(expected, rel=1e-9)
    assert expected == pytest.approx(target, rel=1e-3)


def test_learning_takes_bounded_passages_from_the_whole_text(spark):
    assert quality_classifier.spread_over(5, 9, 10).tolist() == [5, 6, 7, 8]
    assert quality_classifier.spread_over(0, 1000, 4).tolist() == [0, 250, 500, 750]
    rows = [(1, "plain words here " * 5000), (2, "## $$ !! " * 5000), (3, ""), (4, None)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    model = quality_classifier.learn(own, marks, max_passages=3)
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(own, model).collect()}
    assert set(got) == {1, 2, 3, 4} and all(0 <= x <= 1 for x in got.values())
