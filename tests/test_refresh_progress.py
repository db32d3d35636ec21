"""Views kept up by deltas, counts heard while writing, and stream progress."""

import logging
import re
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from wordloom.operators.tokens import tokenize_spaced
from wordloom.plans.ingest import ingest_batch
from wordloom.plans.store import VIEWS, VocabularyStore
from wordloom.schemas import DOCUMENTS
from wordloom.session import work_folder
from wordloom.streaming.ingest import start_ingest, stream_documents
from wordloom.streaming.progress import listen


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id long, text string, language string")


@pytest.fixture
def store(spark):
    return VocabularyStore(spark, work_folder(spark, "store"))


def same_as_the_log(store, rows):
    for name in VIEWS:
        whole = store.view(name)
        assert rows(store.read_view(name), *whole.columns) == rows(whole), name


BATCHES = [
    [(1, "un un\ndeux", "fr"), (2, "one", "en"), (3, "un", "fr")],
    [(1, "un un\ndeux\nun trois\nun a\nun b\nun c\nun d", "fr"), (4, "one two", "en")],
    [(3, "neu\nun", "fr"), (2, "one\none\ntwo", "en"), (1, "un un\ndeux", "de")],
]


def test_refreshed_views_equal_views_of_the_whole_log(spark, store, rows):
    for batch in BATCHES:
        ingest_batch(store, texts(spark, *batch), drop_ascii=False)
        store.refresh_views()
        same_as_the_log(store, rows)
    kept = store._version("words")
    store.refresh_views()  # nothing is new: nothing is written
    assert store._version("words") == kept


def test_refresh_after_sources_were_taken_back(spark, store, rows):
    ingest_batch(store, texts(spark, *BATCHES[0]), drop_ascii=False)
    store.refresh_views()
    store.retract(texts(spark, (1, "", ""), (4, "", "")))
    ingest_batch(store, texts(spark, *BATCHES[1]), drop_ascii=False)
    store.refresh_views()
    same_as_the_log(store, rows)
    ingest_batch(store, texts(spark, *BATCHES[2]), drop_ascii=False)
    store.refresh_views()
    same_as_the_log(store, rows)


def test_refresh_reads_only_new_facts(spark, store):
    for batch in BATCHES:
        ingest_batch(store, texts(spark, *batch), drop_ascii=False)
    assert {r["seq"] for r in store.facts(after=1).collect()} == {2}
    plan = store.facts(after=1)._jdf.queryExecution().executedPlan().toString()
    filters = [x.split("PartitionFilters:")[1] for x in plan.split("\n") if "PartitionFilters:" in x]
    assert any(re.search(r"stream#\d+ = jobs.*batch_id#\d+L? = 2\b", f.split("PushedFilters")[0]) for f in filters), filters


def test_the_last_reading_wins_through_refreshes(spark, store, rows):
    def reading(text):
        return lambda s: tokenize_spaced(s).withColumn("reading", F.lit(text))

    for source, kana in ((9, "フルイ"), (5, "アタラシイ"), (7, "")):
        ingest_batch(store, texts(spark, (source, "word", "xx")), tokenizer=reading(kana), drop_ascii=False)
        store.refresh_views()
    assert [r["pronunciation"] for r in store.read_view("words").collect()] == ["あたらしい"]
    same_as_the_log(store, rows)


def test_definitions_are_in_refreshed_words(spark, store):
    from wordloom.operators.dictionary import term_matches
    from wordloom.schemas import ENTRY

    entry = ("1", [], [("un", True, [])], [(["n"], [("one", "eng")])])
    matches = term_matches(spark.createDataFrame([entry], ENTRY))
    ingest_batch(store, texts(spark, *BATCHES[0]), drop_ascii=False)
    store.refresh_views()
    assert store.backfill(matches) == 1
    store.refresh_views()
    ingest_batch(store, texts(spark, *BATCHES[1]), drop_ascii=False)
    store.refresh_views()
    found = {r["word"]: r["definitions"] for r in store.read_view("words").collect()}
    assert found["un"][0]["senses"] == ["one"] and found["trois"] is None


def test_views_written_with_other_rows_are_made_anew(spark, store, rows):
    ingest_batch(store, texts(spark, *BATCHES[0]), drop_ascii=False)
    store.write_view("word_sources", store.view("word_sources").where("word = 'un'"))
    store.refresh_view("word_sources")
    whole = store.view("word_sources")
    assert rows(store.read_view("word_sources"), *whole.columns) == rows(whole)


def test_counts_heard_equal_counts_stored(spark, store, caplog):
    heard, steps = [], []
    with caplog.at_level(logging.INFO, logger="wordloom"):
        for batch in [*BATCHES, [(8, "!", "fr")], [(8, "!", "fr")]]:
            ingest_batch(store, texts(spark, *batch), drop_ascii=False, on_batch=lambda *a: heard.append(a),
                         on_progress=lambda *a: steps.append(a))
    stored = [(r["batch_id"], r["sentences"], r["links"]) for r in store.batches().orderBy("seq").collect()]
    assert heard == stored
    sums = {r["seq"]: (r["n"], r["links"]) for r in store.facts().groupBy("seq").agg(
        F.count_distinct("source_id", "sentence_idx").alias("n"), F.sum("n").alias("links")).collect()}
    assert [links for *_, links in heard] == [sums.get(i, (0, 0))[1] for i in range(5)]
    assert [n for _, n, _ in heard] == [
        store.sentences().where(f"seq = {i}").count() for i in range(5)]
    assert heard[3] == (3, 1, 0) and heard[4] == (4, 0, 0)  # a sentence without words, and nothing new
    assert [s[0] for s in steps[:3]] == ["sentences", "facts", "committed"]
    assert sum("committed" in m for m in caplog.messages) == 5


def test_a_listener_hears_batches_and_the_end(spark, store, tmp_path):
    inbox = str(tmp_path / "inbox")
    for n in range(2):
        spark.createDataFrame([(n, f"un {n}", "xx", "s", 4)], DOCUMENTS).coalesce(1).write.mode("append").parquet(inbox)
    batches, ends = [], []
    listener = listen(spark, lambda *a: batches.append(a), lambda *a: ends.append(a))
    try:
        stream = stream_documents(spark, inbox, files_per_batch=1)
        start_ingest(store, stream, str(tmp_path / "cp"), drop_ascii=False).awaitTermination()
        bad = lambda s: tokenize_spaced(s).withColumn("base_form", F.raise_error(F.lit("bad")))
        with pytest.raises(StreamingQueryException):
            start_ingest(store, stream, str(tmp_path / "cp2"), drop_ascii=False, tokenizer=bad, resume=False).awaitTermination()
        until = time.time() + 20
        while len(ends) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    stored = {(r["stream"], r["batch_id"]) for r in store.batches().collect()}
    assert {(b[0], b[1]) for b in batches} == stored and len(stored) == 2
    assert [e[1] is None for e in ends] == [True, False]
