import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wordloom.operators import integrity, views
from wordloom.operators.facts import (
    analysed_facts,
    sentence_words,
    spaced_facts,
    validate,
    vocabulary_tokens,
)
from wordloom.operators.sentences import with_sentence_id
from wordloom.operators.tokens import tokenize_spaced, tokenize_with
from wordloom.operators.sentences import after_progress

CAT, DOG, BIRD = ("猫", "猫", "ネコ", "名詞"), ("犬", "犬", "イヌ", "名詞"), ("鳥", "鳥", "トリ", "名詞")


def test_filter_and_lemma(tokens, rows):
    df = tokens(
        [(1, 0, "手紙を書いました", [
            ("手紙", "手紙", "テガミ", "名詞"), ("を", "を", "ヲ", "助詞"),
            ("書い", "書く", "カイ", "動詞"), ("まし", "ます", "マシ", "助動詞")])]
    )
    facts = sentence_words(vocabulary_tokens(df))
    assert sorted(rows(facts, "first_token_idx", "word", "reading")) == [
        (0, "手紙", "てがみ"), (2, "書く", "かい")]
    assert views.total_links(facts).first()["links"] == 2


def test_repeat_in_sentence(tokens, rows):
    df = tokens([(1, 0, "猫は猫である", [CAT, ("は", "は", "ハ", "助詞"), CAT])])
    facts = sentence_words(vocabulary_tokens(df))
    assert views.total_links(facts).first()["links"] == 2
    assert rows(views.occurrence_counts(facts)) == [(1, "猫", 2)]
    assert views.top_contexts(facts).count() == 1


def test_order_of_first_appearance(tokens, rows):
    df = tokens([(1, 0, "猫犬猫鳥", [CAT, DOG, CAT, BIRD]), (1, 5000, "x", [DOG]), (2, 0, "y", [BIRD])])
    facts = sentence_words(vocabulary_tokens(df))
    got = sorted(rows(views.words_in_order(facts), "source_id", "word_no", "word"))
    assert got == [(1, 1, "猫"), (1, 2, "犬"), (1, 3, "鳥"), (2, 1, "鳥")]


def test_order_over_many_buckets(spark):
    data = [(1, i * 700, f"s{i}", f"w{i % 37}", 1, i % 3) for i in range(200)]
    facts = spark.createDataFrame(
        data, "source_id long, sentence_idx long, sentence_id string, word string, n long,"
        " first_token_idx long",
    )
    got = [r["word"] for r in views.words_in_order(facts).orderBy("word_no").collect()]
    assert got == [f"w{i}" for i in range(37)]


def test_first_non_empty_reading(tokens, rows):
    df = tokens([(1, 0, "s", [("猫", "猫", "", "名詞"), ("猫", "猫", "ネコ", "名詞"), ("猫", "猫", "ビョウ", "名詞")])])
    assert rows(sentence_words(vocabulary_tokens(df)), "word", "n", "reading") == [("猫", 3, "ねこ")]
    bare = sentence_words(vocabulary_tokens(df), readings=False)
    assert rows(bare, "word", "n", "reading") == [("猫", 3, "")]


def test_resume(spark):
    sentences = spark.createDataFrame(
        [(1, i, "テスト") for i in range(10)] + [(2, 0, "x"), (3, 0, "y")],
        "source_id long, sentence_idx long, sentence string",
    )
    progress = spark.createDataFrame([(1, 4), (3, None)], "source_id long, last_processed long")
    left = after_progress(sentences, progress)
    assert left.where("source_id = 1").count() == 5
    assert left.where("source_id in (2, 3)").count() == 2


FACTS = "source_id long, word string, sentence_idx long, sentence_id string, n long"


def seven_contexts(spark):
    texts = [f"Context sentence {i}." for i in range(1, 8)]
    data = [(1, "w", i, t, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data + [(1, "w", 9, texts[0], 1)], FACTS)


def test_contexts_are_the_first_five_distinct(spark, rows):
    facts = seven_contexts(spark)
    assert rows(views.occurrence_counts(facts)) == [(1, "w", 8)]
    got = sorted(rows(views.top_contexts(facts), "context_no", "sentence_id"))
    assert got == [(i, f"Context sentence {i}.") for i in range(1, 6)]


def test_latest_context_wins(spark, rows):
    facts = spark.createDataFrame(
        [(1, "鳥", 0, "最初の文。", 1), (1, "鳥", 1, "更新された文。", 1)], FACTS
    )
    assert rows(views.latest_context(facts)) == [(1, "鳥", "更新された文。")]
    link = views.word_sources(facts, contexts=True).first()
    assert (link["occurrence_count"], link["context_sentence_id"]) == (2, "更新された文。")


def test_progress_counts_sentences_without_words(spark, rows):
    df = spark.createDataFrame([(1, 0), (1, 8), (2, 3)], "source_id long, sentence_idx long")
    assert rows(views.source_progress(df)) == [(1, 8), (2, 3)]


def test_upsert_words(spark, rows):
    data = [
        ("犬", "犬", "ja", "いぬ", "", 1), (" 犬　", "犬", "ja", "", "[1]", 2), ("犬", "犬", "ja", "けん", None, 3),
        ("犬", "犬", "ja", "", "", 4), ("犬", "犬", None, None, None, 5), ("  ", "", "ja", "x", "", 6),
        ("犬", " 犬", "ja", "", "[2]", 0),
    ]
    df = spark.createDataFrame(
        data, "word string, lemma string, language string, pronunciation string,"
        " definitions string, ord int",
    )
    got = views.upsert_words(df, ["ord"])
    assert sorted(rows(got.drop("word_id"))) == [
        ("犬", "犬", "ja", "けん", "[1]"), ("犬", "犬", "und", "", "")]
    assert got.select("word_id").distinct().count() == 2


def test_dedup_sources(spark, rows):
    data = [
        (2, "late", None, "t", "", "w2", "m2"), (1, " web ", "", "t", None, "w1", None),
        (3, "web", "u", "t", "", "w3", ""), (4, "　 ", "v", "", "", "", ""),
    ]
    df = spark.createDataFrame(
        data, "ord int, source_type string, url string, title string, author string,"
        " website string, meta string",
    )
    got = views.dedup_sources(df, ["ord"]).drop("source_key")
    assert rows(got) == [("", "t", "", "web", "w1", ""), ("u", "t", "", "web", "w3", "")]


def test_words_by_source_reads_null_as_empty(spark, rows):
    words = spark.createDataFrame([("a", "魚", "さかな", None), ("b", "犬", None, None)],
                                  "word_id string, word string, pronunciation string, image_url string")
    links = spark.createDataFrame([(1, "a"), (2, "b")], "source_id long, word_id string")
    assert rows(views.words_by_source(words, links, 1)) == [("a", "魚", "さかな", "", 1)]
    assert views.words_by_source(words, links).count() == 2


def test_words_written_alike_are_told_apart(spark, rows):
    words = spark.createDataFrame([("a", "run", "run"), ("b", "run", "runs")], "word_id string, word string, lemma string")
    links = spark.createDataFrame([(1, "a")], "source_id long, word_id string")
    assert rows(views.words_by_source(words, links), "lemma") == [("run",)]


def test_validate(spark, rows):
    data = [("web", "a", 1, 1, 1), ("  ", "a", 1, 1, 1), ("web", "　", 1, 1, 1), ("web", "a", 0, 1, 1),
            ("web", "a", -1, 1, 1), ("web", "a", 1, 0, 1), ("web", "a", 1, 1, 0), ("web", None, 1, 1, 1)]
    df = spark.createDataFrame(
        data, "source_type string, word string, word_id long, source_id long, n int")
    reasons = [r["reason"] for r in validate(df).collect()]
    assert reasons == [
        None, "source_type must be non-empty", "word must be non-empty", "word_id must be positive",
        "word_id must be positive", "source_id must be positive", "increment must be positive",
        "word must be non-empty",
    ]
    assert validate(df.limit(1), strict=True).count() == 1
    with pytest.raises(PySparkException, match="must be"):
        validate(df, strict=True).collect()


def test_insert_ignore(spark, rows):
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 9, 0), ("b", 3, 2), ("b", 2, 1)], "k string, v int, ord int")
    assert rows(integrity.insert_ignore(old, new, ["k"], ["ord"])) == [("a", 1), ("b", 2)]
    keys = integrity.insert_ignore(old.select("k"), new.select("k"), ["k"], [])
    assert rows(keys) == [("a",), ("b",)]


def test_orphans_and_retraction(spark, rows):
    links = spark.createDataFrame([(1, "a", 2), (2, "a", 3), (3, "b", 1)],
                                  "source_id long, word string, n long")
    sources = spark.createDataFrame([(1,), (2,), (2,)], "source_id long")
    assert rows(integrity.orphans(links, sources, ["source_id"]), "source_id") == [(3,)]
    left = integrity.retract(links, sources.where("source_id = 2"))
    assert rows(views.occurrence_counts(left)) == [(1, "a", 2), (3, "b", 1)]


def test_a_hot_pair_gives_the_same_answer(spark):
    """A third of all rows under one word and source."""
    hot = spark.range(30000).selectExpr(
        "1L source_id", "'hot' word", "id sentence_idx", "concat('s', id % 11) sentence_id", "1L n")
    cold = spark.range(60000).selectExpr(
        "id % 97 source_id", "concat('w', id % 89) word", "id sentence_idx",
        "concat('s', id % 301) sentence_id", "1L n")
    facts = hot.unionByName(cold).repartition(8)
    top = views.top_contexts(facts).where("word = 'hot'").orderBy("context_no").collect()
    assert [r["sentence_id"] for r in top] == ["s0", "s1", "s2", "s3", "s4"]
    counts = views.occurrence_counts(facts)
    assert counts.where("word = 'hot'").first()["occurrence_count"] == 30000
    assert counts.agg(F.sum("occurrence_count")).first()[0] == 90000


def test_a_hot_word_is_split_when_links_are_joined(spark):
    """AQE cuts the partition of a word that a third of all links share."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in small}
    for key, val in small.items():
        spark.conf.set(key, val)
    try:
        hot = spark.range(20000).selectExpr("id source_id", "'hot' word")
        cold = spark.range(40000).selectExpr("id source_id", "concat('w', id % 997) word")
        links = hot.unionByName(cold).repartition(8, "source_id")
        links = links.withColumnRenamed("word", "word_id")
        words = links.select("word_id").distinct().withColumn("pronunciation", F.lit("x"))
        joined = views.words_by_source(words, links)
        assert joined.collect() and joined.count() == 60000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, val in before.items():
            spark.conf.unset(key) if val is None else spark.conf.set(key, val)


def analyser():
    """Characters as tokens; upper case is the base form of lower case, digits are particles."""

    def analyse(batch: pd.Series) -> pd.Series:
        def features(c):
            return ["助詞" if c.isdigit() else "名詞", "一般", "*", "*", "*", "*",
                    "*" if c == "x" else c.upper(), "ネ" if c in "aC" else "*"]

        return batch.map(lambda t: [{"surface": c, "features": features(c)} for c in t])

    return analyse


def test_counting_in_the_row_equals_grouping(spark, rows):
    texts = ["b a a! b 12 é a", "!!", "é É é x", "cabCA bcx1 2aé é", "z" * 3 + " " + "z" * 3]
    df = with_sentence_id(spark.createDataFrame(
        [(1, i, t) for i, t in enumerate(texts)], "source_id long, sentence_idx long, sentence string"))
    for drop_ascii in (True, False):
        grouped = sentence_words(vocabulary_tokens(tokenize_spaced(df), drop_ascii), readings=False)
        assert rows(spaced_facts(df, drop_ascii), *grouped.columns) == rows(grouped)
        grouped = sentence_words(vocabulary_tokens(tokenize_with(df, analyser()), drop_ascii))
        assert rows(analysed_facts(df, analyser(), drop_ascii), *grouped.columns) == rows(grouped)
    assert "ね" in [r[0] for r in rows(grouped, "reading")]
