"""A dictionary of one large document, and lookups that move only words that may be found."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wordloom.operators import dictionary
from wordloom.operators.sieve import build_sieve, sift
from wordloom.sources.entry_list import read_entry_list
from wordloom.sources.readers import read_dictionary


def entry(i, **more):
    return {
        "id": str(i),
        "kanji": [{"text": f'語{i} {{"id": "x"', "common": True, "tags": []}],
        "kana": [{"text": "id", "common": False, "tags": ["id"]}],
        "sense": [{"partOfSpeech": ["n"], "gloss": [{"text": "id", "lang": "eng"}]}],
        **more,
    }


def written(tmp_path, document, **how):
    path = tmp_path / "dictionary.json"
    path.write_text(document if isinstance(document, str) else json.dumps(document, ensure_ascii=False, **how), "utf-8")
    return str(path)


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("how", [{}, {"indent": 2}, {"separators": (",", ":")}])
@pytest.mark.parametrize("form", ["words", "bare", "words first", "words last"])
def test_one_document_is_read_by_many_tasks(spark, rows, tmp_path, small_splits, how, form):
    entries = [entry(i, extra={"n": i}) for i in range(300)]
    document = {
        "words": {"words": entries},
        "bare": entries,
        "words first": {"words": entries, "tags": {"n": "noun"}},
        "words last": {"version": "1", "tags": {"n": "noun"}, "words": entries},
    }[form]
    path = written(tmp_path, document, **how)
    found = read_entry_list(spark, path)
    assert found.rdd.getNumPartitions() > 4
    assert rows(found) == rows(read_dictionary(spark, path))
    assert found.schema == read_dictionary(spark, path).schema


def test_uneven_white_space_and_single_entries(spark, tmp_path):
    own = [json.dumps(entry(i), separators=(",", ":")) for i in range(4)]
    own[2] = json.dumps(entry(2), indent=4)
    text = "﻿ [" + " , \n".join(own) + " ] \n"
    found = read_entry_list(spark, written(tmp_path, text))
    assert sorted(r.id for r in found.collect()) == ["0", "1", "2", "3"]
    alone = read_entry_list(spark, written(tmp_path, entry(7), indent=1))
    assert [r.id for r in alone.collect()] == ["7"]
    lines = read_entry_list(spark, written(tmp_path, '{"id":"1"}\n{"id":"2"}\n'))
    assert sorted(r.id for r in lines.collect()) == ["1", "2"]
    numbers = read_entry_list(spark, written(tmp_path, '[{"id":5},{"id":6}]'))
    assert sorted(r.id for r in numbers.collect()) == ["5", "6"]
    for none in ("[]", ""):
        assert read_entry_list(spark, written(tmp_path, none)).count() == 0


@pytest.mark.parametrize(
    "document",
    [
        '{"words":[{"id":"1","parts":[{"id":"2"}]}]}',
        '{"words":[{"id":"1","part":{"id":"2"}},{"id":"3"}]}',
        '{"words":[{"id":"1"}],"names":[{"id":"2"}]}',
        '{"names":[{"id":"1"}]}',
        '{"words":[{"kana":[],"id":"1"},{"id":"2"}]}',
        '{"words":[{"id":"1"},{"id":"2"',
        '{"version":"1"}',
        '{"words":[]}',
    ],
)
def test_documents_cut_wrongly_fail(spark, tmp_path, document):
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_entry_list(spark, written(tmp_path, document)).collect()


def test_the_sieve_passes_every_key_and_few_others(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    keys = keys.unionByName(spark.createDataFrame([(None,)], "key string"))
    rows = spark.range(60000).select(F.concat(F.lit("k"), "id").alias("word"), (F.col("id") < 20000).alias("known"))
    rows = rows.unionByName(spark.createDataFrame([(None, False)], "word string, known boolean"))
    marked = sift(rows, build_sieve(keys, "key"), F.col("word"), "maybe")
    assert marked.count() == 60001
    assert marked.where("known and not maybe").isEmpty()
    assert marked.where("not known and maybe").count() < 40000 * 0.05
    assert not marked.where("word is null").first().maybe
    nothing = sift(rows, build_sieve(keys.limit(0), "key"), F.col("word"), "maybe")
    assert nothing.where("maybe").isEmpty()


def test_a_sifted_lookup_finds_the_same(spark, rows, tmp_path):
    matches = dictionary.term_matches(read_dictionary(spark, written(tmp_path, [entry(i) for i in range(50)])))
    words = spark.createDataFrame(
        [("id", "id", ""), ("none", "id", "id"), ("none", None, "x"), (None, None, None), ('語3 {"id": "x"', "q", "")]
        + [(f"w{i}", f"w{i}", "") for i in range(500)],
        "word string, lemma string, pronunciation string",
    )
    for reading in (False, True):
        plain = dictionary.lookup(words, matches, reading, small=False)
        assert rows(dictionary.sifted_lookup(words, matches, reading)) == rows(plain)
    assert rows(dictionary.sifted_lookup(words.drop("lemma"), matches)) == rows(
        dictionary.lookup(words.drop("lemma"), matches, small=False)
    )
    moved = sift(words, build_sieve(matches, "term"), F.col("word"), "maybe").where("maybe").count()
    assert moved < 30


def test_a_sifted_lookup_makes_its_words_once(spark, tmp_path):
    matches = dictionary.term_matches(read_dictionary(spark, written(tmp_path, [entry(i) for i in range(5)])))
    words = spark.range(100).select(F.concat(F.lit("w"), F.col("id") % 7).alias("word")).distinct()
    found = dictionary.sifted_lookup(words, matches)
    assert len(found.collect()) == 7
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Range (") == 1
