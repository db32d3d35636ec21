"""What views of the store move, and that links and contexts stay right where ids travel as bytes."""

import pytest
from pyspark.sql import functions as F

from wordloom.plans import store as stores
from wordloom.plans.ingest import ingest_batch
from wordloom.plans.store import VocabularyStore
from wordloom.session import work_folder


@pytest.fixture
def store(spark):
    store = VocabularyStore(spark, work_folder(spark, "store"))
    rows = [(1, "un un\ndeux", "fr"), (2, "un", None), (3, "un\ndeux un", "")]
    ingest_batch(store, spark.createDataFrame(rows, "source_id long, text string, language string"), drop_ascii=False)
    return store


@pytest.mark.parametrize("name", ["word_sources", "word_contexts"])
def test_a_pair_view_is_shuffled_once_and_lies_in_ranges(store, name):
    text = store.view(name)._jdf.queryExecution().executedPlan().toString()
    assert text.count("rangepartitioning(") == 1 and "hashpartitioning(source_id" not in text, text[:3000]
    view = store.view(name)
    assert stores._LAID_OUT[view] == ["source_id", "word"]


def test_links_have_ids_as_before(store, rows):
    links = store.write_view("word_sources", store.view("word_sources"), ["source_id", "word"])
    md5 = lambda text: F.md5(F.lit(text))
    got = links.where("source_id = '3' AND word = 'un'").select(
        (F.col("context_sentence_id") == md5("deux un")).alias("context"),
        (F.col("word_id") == md5("2:un2:un0:")).alias("word"), "occurrence_count")
    assert rows(got) == [(True, True, 2)]
    assert links.where(F.col("word_id") == md5("2:un2:un2:fr")).count() == 1


def test_words_without_a_reading_are_folded_before_the_sort(store):
    text = store.view("words")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [word") >= 2


def test_tables_are_small_on_disk(store):
    links = store.write_view("word_sources", store.view("word_sources"), ["source_id", "word"])
    assert all(".zstd." in f for f in links.inputFiles())
