import gzip
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wordloom.functions import definitions as D
from wordloom.operators import dictionary
from wordloom.schemas import ENTRY
from wordloom.sources.readers import read_dictionary


def entry(id, kanji, kana, glosses, pos):
    return {
        "id": id,
        "kanji": [{"text": k, "common": True} for k in kanji],
        "kana": [{"text": k, "common": c} for k, c in kana],
        "sense": [{"gloss": [{"text": g} for g in glosses], "partOfSpeech": pos}],
    }


ENTRIES = [
    entry("1", ["犬"], [("いぬ", True)], ["dog"], ["n"]),
    entry("2", ["走る"], [("はしる", True)], ["to run"], ["v5r"]),
    entry("3", ["猫"], [("ねこ", True)], ["cat"], ["n"]),
    entry("4", [], [("テスト", True)], ["test"], ["n", "vs"]),
]


def write(tmp_path, content, name="dict.json"):
    path = tmp_path / name
    path.write_text(content if isinstance(content, str) else json.dumps(content, indent=1), "utf8")
    return str(path)


@pytest.fixture
def entries(spark):
    def build(items):
        return spark.createDataFrame([json.dumps(i) for i in items], "string").select(
            F.from_json("value", ENTRY).alias("e")).select("e.*")
    return build


@pytest.fixture
def matches(entries):
    return dictionary.term_matches(entries(ENTRIES))


def test_load_wrapper_and_array(spark, tmp_path):
    assert read_dictionary(spark, write(tmp_path, {"words": ENTRIES})).count() == 4
    assert read_dictionary(spark, write(tmp_path, ENTRIES)).count() == 4
    assert read_dictionary(spark, write(tmp_path, "[]")).count() == 0


def test_load_lines_of_any_form(spark, tmp_path):
    lines = [json.dumps({"words": ENTRIES[:2]}), json.dumps(ENTRIES[2:3]), json.dumps(ENTRIES[3])]
    df = read_dictionary(spark, write(tmp_path, "\n".join(lines)), multi_line=False)
    assert [r["id"] for r in df.orderBy("id").collect()] == ["1", "2", "3", "4"]


def test_load_compressed(spark, tmp_path):
    path = tmp_path / "dict.json.gz"
    path.write_bytes(gzip.compress(json.dumps({"words": ENTRIES}).encode()))
    assert read_dictionary(spark, str(path)).count() == 4


@pytest.mark.parametrize("content", ['{"words": []}', "{}", '{"words": [', "not json"])
def test_load_errors(spark, tmp_path, content):
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_dictionary(spark, write(tmp_path, content)).collect()


def test_missing_fields_are_empty(entries, rows):
    df = entries([{"id": "9", "kana": [{"text": "あ"}]}, {"id": "8", "kanji": [{"text": "亜"}]}])
    assert rows(dictionary.dictionary_terms(df)) == [("あ", "9"), ("亜", "8")]
    got = df.select(
        D.entry_senses(F.col("sense")).alias("s"), D.primary_kana(F.col("kana")).alias("k"))
    assert sorted(map(tuple, got.collect()), key=repr) == [([], "あ"), ([], None)]


def test_a_term_counts_once_per_entry(entries, rows):
    df = entries([entry("1", ["ああ", "ああ", ""], [("ああ", False)], [], [])])
    assert rows(dictionary.dictionary_terms(df)) == [("ああ", "1")]


WORDS = [("犬", "犬", "イヌ", None), ("走る", "走る", "ハシル", ""), ("未知", "未知", "ミチ", ""),
         ("猫", "猫", "ネコ", ""), ("テスト", "テスト", "テスト", None), ("鳥", "鳥", "", "[kept]")]
WORD_SCHEMA = "word string, lemma string, pronunciation string, definitions string"


def test_backfill(spark, matches, rows):
    got = dictionary.backfill_definitions(spark.createDataFrame(WORDS, WORD_SCHEMA), matches)
    assert got.where("updated").count() == 4
    table = {r["word"]: (r["definitions"], r["pronunciation"]) for r in got.collect()}
    assert table["テスト"] == ('[{"senses":["test"],"pos":["n","vs"]}]', "テスト")
    assert table["未知"] == ("", "ミチ")
    assert table["鳥"] == ("[kept]", "")


def test_reading_is_checked_only_when_asked(spark, matches):
    words = spark.createDataFrame([("犬", "犬", "ケン")], "word string, lemma string, pronunciation string")
    assert dictionary.lookup_rows(words, matches).count() == 1
    assert dictionary.lookup_rows(words, matches, match_reading=True).count() == 0


def test_word_or_lemma_sorted_as_text_without_repeats(spark, entries, rows):
    matches = dictionary.term_matches(
        entries([entry("9", ["甲"], [], ["a"], []), entry("10", ["乙"], [], ["b"], []),
                 entry("2", ["甲", "乙"], [], ["c"], [])]))
    words = spark.createDataFrame([("甲", "乙"), ("甲", "甲"), ("甲", ""), ("", None)], "word string, lemma string")
    got = sorted(rows(dictionary.lookup_rows(words, matches)))
    assert got == [("甲", "", "2", 1), ("甲", "", "9", 2), ("甲", "乙", "10", 1), ("甲", "乙", "2", 2),
                   ("甲", "乙", "9", 3), ("甲", "甲", "2", 1), ("甲", "甲", "9", 2)]


def test_enrich_overrides_the_reading(spark, entries, rows):
    matches = dictionary.term_matches(
        entries([entry("1", ["上手"], [("カミテ", False), ("ジョウズ", True)], ["skill"], ["n"]),
                 entry("2", ["上手"], [("うわて", True)], [], []),
                 entry("3", ["下手"], [("ヘタ", False)], ["poor"], ["n"]),
                 entry("4", ["印"], [], ["mark"], ["n"])]))
    words = spark.createDataFrame([("上手", "x"), ("下手", "x"), ("印", "x"), ("無", "x")],
                                  "word string, reading string")
    got = dictionary.enrich_words(words, matches)
    assert sorted(rows(got, "word", "pronunciation")) == [
        ("上手", "じょうず"), ("下手", "へた"), ("印", "x"), ("無", "x")]
    text = {r["word"]: r["j"] for r in got.withColumn("j", D.definitions_json(F.col("definitions"))).collect()}
    assert text["上手"] == '[{"senses":["skill"],"pos":["n"]},{"senses":null,"pos":null}]'
    assert text["無"] == ""
    bare = dictionary.enrich_words(words, None)
    assert rows(bare, "pronunciation") == [("x",)] * 4
    assert bare.where("size(definitions) = 0").count() == 4


def test_json_text_is_escaped(entries):
    df = entries([entry("1", [], [], ['a <b> & "c" \\ é', "x y"], ["n"])])
    one = F.array(F.struct(D.entry_senses(F.col("sense")).alias("senses"),
                           D.entry_pos(F.col("sense")).alias("pos")))
    text = df.select(D.definitions_json(one)).first()[0]
    assert text == (
        '[{"senses":["a \\u003cb\\u003e \\u0026 \\"c\\" \\\\ é","x\\u2028y"],"pos":["n"]}]')


def test_senses_and_pos_keep_order_and_repeats(entries):
    item = entry("1", [], [], ["b", "a"], ["n", "vs"])
    item["sense"].append({"gloss": [{"text": "b"}], "partOfSpeech": ["n"]})
    item["sense"].append({"gloss": None})
    row = entries([item]).select(
        D.entry_senses(F.col("sense")).alias("s"), D.entry_pos(F.col("sense")).alias("p")).first()
    assert (row["s"], row["p"]) == (["b", "a", "b"], ["n", "vs", "n"])
