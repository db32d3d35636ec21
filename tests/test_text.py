import time

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as X
from wordloom.operators.sentences import distinct_sentences, split_sentences


def value(spark, text, expression):
    df = spark.createDataFrame([(text,)], "x string")
    return df.select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<ruby>漢字<rt>かんじ</rt></ruby>", "<ruby>漢字</ruby>"),
        ("<ruby>漢字<rp>(</rp><rt>かんじ</rt><rp>)</rp></ruby>", "<ruby>漢字</ruby>"),
        (
            "<ruby>私<rt>わたし</rt></ruby>は<ruby>猫<rt>ねこ</rt></ruby>である",
            "<ruby>私</ruby>は<ruby>猫</ruby>である",
        ),
        (
            "<ruby class='test'>漢字<rt class='reading'>かんじ</rt></ruby>",
            "<ruby class='test'>漢字</ruby>",
        ),
        ("a<RT\n>x\ny</rt>b", "ab"),
        ("<rtc>kept</rtc>", "<rtc>kept</rtc>"),
        ("<rt>open <b>x</b> <rt>y</rt>z", "z"),
        ("<rt>never closed", "<rt>never closed"),
        ("a<rt>b</RT>c<rt>d<rp>e</rp>f<rp>g", "ac<rt>df<rp>g"),
        ("İ<rt>b</rt>İ", "İİ"),
        ("", ""),
        (None, None),
    ],
)
def test_strip_ruby(spark, html, expected):
    assert value(spark, html, X.strip_ruby) == expected


def test_strip_ruby_without_end_tags_takes_linear_time(spark):
    page = "漢<rt>かん" * 500_000
    start = time.perf_counter()
    assert value(spark, "<rt>x</rt>" + page, X.strip_ruby) == page
    assert time.perf_counter() - start < 30


@pytest.mark.parametrize(
    "text, expected",
    [(t, e) for t, e in zip("アイカガパンー", "あいかがぱんー")]
    + [("abc", "abc"), ("あいう", "あいう"), ("ァヶヷ", "ぁゖヷ")],
)
def test_to_hiragana(spark, text, expected):
    assert value(spark, text, X.to_hiragana) == expected


def test_pieces_join_to_the_text(spark):
    for text in ("A。B！C？D\n\n  E　。tail", "。", "", "no end", "a.b!c?"):
        pieces = value(spark, text, X.sentence_pieces)
        assert "".join(pieces) == text
    assert value(spark, "a.b!c?", X.sentence_pieces) == ["a.b!c?"]


def test_split_drops_blanks_before_numbering(spark, rows):
    df = spark.createDataFrame([(7, "A。B！C？D\n\n  E　。tail")], "source_id long, text string")
    raw = rows(split_sentences(df, trimmed=False))
    assert raw == [
        (7, 0, "A。"), (7, 1, "B！"), (7, 2, "C？"), (7, 3, "D\n"), (7, 4, "  E　。"), (7, 5, "tail"),
    ]
    assert [r[2] for r in rows(split_sentences(df))] == ["A。", "B！", "C？", "D", "E　。", "tail"]


def test_parts_keep_order_without_counting(spark, rows):
    df = spark.createDataFrame(
        [(1, 0, "a\nb"), (1, 2, "c\n")], "source_id long, turn long, text string"
    )
    got = rows(split_sentences(df, part="turn"), "sentence_idx", "sentence")
    assert got == [(0, "a"), (1, "b"), (2 * 2**32, "c")]


def test_unicode_trim_takes_every_white_space(spark):
    assert value(spark, X.WHITE_SPACE + "a　b" + X.WHITE_SPACE, X.unicode_trim) == "a　b"
    assert value(spark, X.WHITE_SPACE, X.unicode_trim) == ""
    assert value(spark, "​x", X.unicode_trim) == "​x"  # not white space


@pytest.mark.parametrize(
    "text, expected",
    [("abc", True), ("a!", True), ("{~}", True), ("a b\t", True), ("é", False), ("", False),
     ("aあ", False), ("a\x0b", False)],
)
def test_is_ascii(spark, text, expected):
    assert value(spark, text, X.is_ascii) is expected


def test_text_id_frames_its_parts(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc")], "x string, y string")
    assert df.select(X.text_id(F.col("x"), F.col("y")).alias("k")).distinct().count() == 3


def test_distinct_sentences(spark, rows):
    df = spark.createDataFrame([(" a。",), ("a。\n",), ("　",), ("b",)], "sentence string")
    assert [r[0] for r in rows(distinct_sentences(df), "sentence")] == ["a。", "b"]
