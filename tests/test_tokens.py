import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wordloom.functions import morph
from wordloom.operators import layout, tokens
from wordloom.operators.facts import vocabulary_tokens
from wordloom.operators.tokens import (
    project_features,
    tokenize_lexicon,
    tokenize_spaced,
    tokenize_with,
)


def test_feature_projection(spark, rows):
    data = [
        ("行っ", ["動詞", "自立", "*", "*", "五段", "連用", "行く", "イッ", "イッ"]),
        ("犬", ["名詞", "一般", "*", "*", "*", "*", "*", "*"]),
        ("X", ["名詞"]),
        ("Y", []),
        ("Z", None),
        ("　", ["記号", "空白"]),
    ]
    df = spark.createDataFrame(data, "surface string, features array<string>")
    got = rows(project_features(df), "surface", "base_form", "reading", "primary_pos")
    assert sorted(got) == sorted(
        [
            ("行っ", "行く", "イッ", "動詞"),
            ("犬", "犬", "", "名詞"),
            ("X", "X", "", "名詞"),
            ("Y", "Y", "", ""),
            ("Z", "Z", "", ""),
        ]
    )


def test_canonical_word(spark):
    df = spark.createDataFrame(
        [("書い", "書く"), ("犬", ""), ("猫", "*"), ("鳥", None)], "s string, b string"
    )
    got = [r[0] for r in df.select(morph.canonical_word(F.col("s"), F.col("b"))).collect()]
    assert got == ["書く", "犬", "猫", "鳥"]


def test_vocabulary_filters(spark, rows):
    data = [
        ("、", ["記号"], "記号"), ("・", ["補助記号"], "補助記号"), ("を", ["助詞"], "助詞"),
        ("まし", ["助動詞"], "助動詞"), ("三", ["名詞", "数"], "名詞"), ("abc", ["名詞"], "名詞"),
        ("手紙", ["名詞", "一般"], "名詞"), ("無", [], None),
    ]
    df = spark.createDataFrame(data, "surface string, pos array<string>, primary_pos string")
    df = df.withColumn("base_form", F.lit("x"))
    assert [r[0] for r in rows(vocabulary_tokens(df), "surface")] == ["手紙", "無"]
    kept = vocabulary_tokens(df, drop_ascii=False)
    assert [r[0] for r in rows(kept, "surface")] == ["abc", "手紙", "無"]


def test_ascii_filter_reads_the_surface(spark, rows):
    df = spark.createDataFrame(
        [("Ａ", "a", ["名詞"], "名詞"), ("a", "あ", ["名詞"], "名詞")],
        "surface string, base_form string, pos array<string>, primary_pos string",
    )
    assert rows(vocabulary_tokens(df), "word") == [("a",)]


def sentences(spark, *texts):
    return spark.createDataFrame(
        [(1, i, t) for i, t in enumerate(texts)],
        "source_id long, sentence_idx long, sentence string",
    )


def test_spaced_tokens(spark, rows):
    df = tokenize_spaced(sentences(spark, "Le chat, 42 É́!"))
    got = sorted(rows(df, "token_idx", "surface", "base_form", "primary_pos"))
    assert got == [
        (0, "Le", "le", "名詞"), (1, "chat", "chat", "名詞"), (2, ",", ",", "記号"),
        (3, "42", "42", "名詞"), (4, "É́", "é́", "名詞"), (5, "!", "!", "記号"),
    ]


def test_plugged_analyser(spark, rows):
    def analyse(batch: pd.Series) -> pd.Series:
        return batch.map(
            lambda t: [{"surface": c, "features": ["名詞", "一般"]} for c in t]
        )

    got = rows(tokenize_with(sentences(spark, "猫 犬"), analyse), "token_idx", "surface", "pos")
    assert got == [(0, "猫", ["名詞", "一般"]), (2, "犬", ["名詞", "一般"])]


def lexicon(spark, terms):
    return spark.createDataFrame(
        [(t, ["名詞", "一般", "*", "*", "*", "*", t + "原", "ヨミ"]) for t in terms],
        "term string, features array<string>",
    )


def test_lexicon_keeps_unknown_text(spark, rows):
    words = lexicon(spark, ["手紙", "手", "を", "書い", "まし", "た"])
    df = tokenize_lexicon(sentences(spark, "手紙をXY書いましたZ"), words)
    got = [r[1:] for r in sorted(rows(df, "token_idx", "surface", "in_lexicon", "base_form"))]
    assert got == [
        ("手紙", True, "手紙原"), ("を", True, "を原"), ("XY", False, "XY"),
        ("書い", True, "書い原"), ("まし", True, "まし原"), ("た", True, "た原"), ("Z", False, "Z"),
    ]


def test_lexicon_cuts_unknown_text_at_scripts(spark, rows):
    df = tokenize_lexicon(sentences(spark, "東京タワーabc12です。犬"), lexicon(spark, ["犬"]))
    got = [r[1] for r in sorted(rows(df, "token_idx", "surface"))]
    assert got == ["東京", "タワー", "abc", "12", "です", "。", "犬"]


def brute_force(text, terms):
    out, at, unknown = [], 0, ""
    while at < len(text):
        best = max((t for t in terms if text.startswith(t, at)), key=len, default=None)
        if best is None:
            unknown += text[at]
            at += 1
            continue
        if unknown:
            out.append(unknown)
            unknown = ""
        out.append(best)
        at += len(best)
    return out + ([unknown] if unknown else [])


@pytest.mark.parametrize("limit", [64 << 20, 300, 0])
def test_lexicon_against_brute_force(spark, monkeypatch, limit):
    """With everything broadcast, with only some sides, and with joins by shuffle alone."""
    monkeypatch.setattr(tokens, "is_small", lambda df, own: layout.is_small(df, min(own, limit)))
    monkeypatch.setattr(layout, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(tokens, "CHUNK", 7)
    rng = random.Random(5)
    terms = {"".join(rng.choice("あいう") for _ in range(rng.randint(1, 5))) for _ in range(12)}
    terms -= {"あ"}
    terms |= {"い・う", "あ。い・", "𠮷野", "𠮷"}
    texts = ["".join(rng.choice("あいうえ・。𠮷野") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    df = tokenize_lexicon(sentences(spark, *texts), lexicon(spark, terms))
    got = {}
    for r in df.orderBy("sentence_idx", "token_idx").collect():
        got.setdefault(r["sentence_idx"], []).append(r["surface"])
    expected = {i: brute_force(t, terms) for i, t in enumerate(texts)}
    assert got == {i: [x for p in ps for x in cut_at_scripts(p, terms)] for i, ps in expected.items()}


def cut_at_scripts(piece, terms):
    return [piece] if piece in terms else re.findall("[あ-え]+|[𠮷野]+|.", piece)


def test_lexicon_terms_may_hold_punctuation_and_spaces(spark, rows):
    words = lexicon(spark, ["アイス・クリーム", "アイス", "New York", " ", ""])
    df = tokenize_lexicon(sentences(spark, "アイス・クリーム、アイス・New York 市", "", None), words)
    got = [r[1:] for r in sorted(rows(df, "token_idx", "surface", "in_lexicon"))]
    assert got == [
        ("アイス・クリーム", True), ("、", False), ("アイス", True), ("・", False),
        ("New York", True), ("市", False),
    ]
    assert sorted(rows(df, "token_idx"))[-1] == (5,)


@pytest.mark.parametrize("small", [True, False])
def test_lexicon_is_linear_in_a_long_run(spark, monkeypatch, small):
    """A run of a million characters by the small lexicon, of 50,000 by joins."""
    monkeypatch.setattr(tokens, "is_small", lambda df, limit: small)
    times = 250_000 if small else 12_500
    df = tokenize_lexicon(sentences(spark, "手紙は犬" * times), lexicon(spark, ["手紙", "犬"]))
    got = df.groupBy("surface", "in_lexicon").count().collect()
    assert {tuple(r) for r in got} == {
        ("手紙", True, times), ("は", False, times), ("犬", True, times),
    }


@pytest.mark.parametrize("seed", range(6))
def test_lexicon_of_few_letters_against_brute_force(spark, monkeypatch, seed):
    """Terms that begin alike, astral characters, and buffers cut between sentences."""
    import random

    from wordloom.operators import tokens as module

    monkeypatch.setattr(module, "PIECE_LETTERS", [5, 40, 1 << 18][seed % 3])
    rng = random.Random(seed)
    alphabet = "ab手紙🙂é"[: 2 + seed % 5]
    terms = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 6))) for _ in range(9)})
    texts = ["".join(rng.choice(alphabet + "x") for _ in range(rng.randint(0, 40))) for _ in range(12)]
    want = []
    for n, text in enumerate(texts):
        at = 0
        while at < len(text):
            size = max((len(t) for t in terms if text.startswith(t, at)), default=0)
            if size:
                want.append((n, text[at : at + size]))
            at += size or 1
    found = tokenize_lexicon(sentences(spark, *texts), lexicon(spark, terms)).where("in_lexicon")
    got = [(r["sentence_idx"], r["surface"]) for r in found.orderBy("sentence_idx", "token_idx").collect()]
    assert got == want
