"""The plans that matter at scale, on inputs that keep the layout of their files."""

import re

import pytest
from pyspark.sql import functions as F

from wordloom.operators import dictionary, layout, views
from wordloom.operators.facts import spaced_facts
from wordloom.operators.sentences import split_sentences, with_sentence_id
from wordloom.plans import corpus, queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.fixture
def as_laid_out(monkeypatch):
    """Take every scan for a large one."""
    monkeypatch.setattr(layout, "SPREAD_BYTES_PER_CORE", 0)


def facts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return spaced_facts(with_sentence_id(split_sentences(docs, "doc_id")))


def test_facts_need_no_shuffle(spark):
    text = plan(facts(spark))
    assert "Exchange" not in text and "Aggregate" not in text


def test_scan_reads_two_columns_and_no_shuffle_precedes_the_tokens(spark, as_laid_out):
    text = plan(corpus.document_words(spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "Exchange" not in text


def test_only_small_scans_are_spread(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert "REPARTITION_BY_NUM" in plan(layout.spread(docs, "doc_id"))
    monkeypatch.setattr(layout, "SPREAD_BYTES_PER_CORE", 1000)
    assert "Exchange" not in plan(layout.spread(docs, "doc_id"))


def test_counts_are_hash_aggregated_before_the_shuffle(spark, as_laid_out):
    text = plan(views.occurrence_counts(corpus.document_words(spark, FOLDER)))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1
    assert re.search(r"Exchange.*\n.*HashAggregate.*partial_count", text)
    assert "SortAggregate" not in text


def test_contexts_are_limited_before_the_second_shuffle(spark, as_laid_out):
    text = plan(views.top_contexts(facts(spark)))
    partial = text.index("5, Partial")
    assert text.index("5, Final") < partial
    assert "Exchange" in text[text.index("5, Final"):partial]
    # Below the partial limit rows are spread by sentence, not by the hot pair alone.
    assert re.search(r"hashpartitioning\(source_id#\d+L, word#\d+, sentence_id#\d+", text[partial:])
    assert "SortAggregate" not in text


def test_lookup_is_two_equi_joins(spark, as_laid_out):
    words = spark.createDataFrame([("a", "b", "")], "word string, lemma string, pronunciation string")
    matches = dictionary.term_matches(corpus.entries(spark, FOLDER))
    text = plan(dictionary.lookup(words, matches, match_reading=True))
    assert text.count("BroadcastHashJoin") == 2
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_words_that_are_their_own_lemma_do_not_meet_under_null(spark, as_laid_out, monkeypatch):
    monkeypatch.setattr(dictionary, "is_small", lambda df: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = spark.createDataFrame([("a", "a"), ("b", None)], "word string, lemma string")
        matches = dictionary.term_matches(corpus.entries(spark, FOLDER))
        text = plan(dictionary.lookup(words, matches))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(coalesce\(lemma#\d+, word#\d+\)", text)


def test_a_large_dictionary_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "is_small", lambda df: layout.is_small(df, 10))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = corpus.corpus_words(spark, FOLDER).select("word", "lemma")
        matches = dictionary.term_matches(corpus.entries(spark, FOLDER))
        df = dictionary.lookup_rows(words, matches)
        assert "Broadcast" not in plan(df) and "SortMergeJoin" in plan(df)
        small = df.agg(F.count(F.lit(1)), F.sum("match_no")).first()
        todo = words.withColumn("pronunciation", F.lit("")).withColumn("definitions", F.lit(""))
        split = dictionary.backfill_definitions(todo, matches).where("updated").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.undo()
    again = dictionary.lookup_rows(words, matches).agg(F.count(F.lit(1)), F.sum("match_no")).first()
    assert small == again
    assert dictionary.backfill_definitions(todo, matches).where("updated").count() == split > 0


WRITES = {"dict_load", "dict_load_split", "sink_roundtrip", "main_text_blocks", "page_vocabulary", "stream_ingest", "stream_running_counts", "stream_running_vocabulary"}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - WRITES))
def test_no_query_crosses_or_leaves_the_jvm(spark, name):
    text = plan(queries.queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert node not in text
    assert ("ArrowEvalPython" in text) == (
        name in {"tokenize_plugged", "analysed_word_counts", "tokenize_lexicon"}
    )
    # These return totals: each task's sums meet in one row.
    assert "SinglePartition" not in text or name in {"total_links", "total_links_all", "backfill_count", "retract_store"}


def test_the_layout_does_not_change_answers(spark, as_laid_out):
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns) % 1000003)).first()
    for name in ("top_contexts", "words_in_order_turns", "latest_context", "main_text_blocks"):
        laid_out = digest(queries.queries()[name](spark, FOLDER))
        layout.SPREAD_BYTES_PER_CORE = 32 << 20
        spread = digest(queries.queries()[name](spark, FOLDER))
        layout.SPREAD_BYTES_PER_CORE = 0
        assert laid_out == spread


def test_numbering_shares_its_shuffle(spark, as_laid_out):
    df = views.words_in_order(facts(spark))
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final
