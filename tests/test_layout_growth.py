"""What moves and how much a task gets when tables grow."""

import pytest
from pyspark.sql import functions as F

from wordloom.operators import layout
from wordloom.plans import corpus, queries

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_tasks_of_a_spread_scan_follow_its_size(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert "RoundRobin" not in plan(layout.spread(docs, "doc_id"))
    size = layout.estimated_bytes(docs)
    monkeypatch.setattr(layout, "SPREAD_BYTES_PER_TASK", size // 40)
    spread = layout.spread(docs, "doc_id")
    assert "hashpartitioning(doc_id#" in plan(spread) and spread.rdd.getNumPartitions() >= 40
    # As large as 12 cores got it in one task before, where a file has one row group.
    monkeypatch.setattr(layout, "estimated_bytes", lambda df: 430 << 20)
    monkeypatch.setattr(layout, "SPREAD_BYTES_PER_TASK", 4 << 20)
    assert layout.spread(docs, "doc_id").rdd.getNumPartitions() == 107


@pytest.mark.parametrize(
    "name", ["occurrence_counts_all", "top_contexts_all", "latest_context_all", "word_sources_all", "total_links_all"])
def test_large_texts_are_moved_once_and_their_words_never(spark, monkeypatch, name):
    monkeypatch.setattr(layout, "estimated_bytes", lambda df: 6 << 30)
    text = plan(queries.queries()[name](spark, FOLDER))
    assert text.count("hashpartitioning") == 1 and "hashpartitioning(source_id#" in text


def test_a_batch_of_unknown_size_is_spread(spark, monkeypatch):
    docs = corpus.table(spark, FOLDER, "documents")
    monkeypatch.setattr(layout, "estimated_bytes", lambda df: 1 << 63)
    assert "hashpartitioning(doc_id" in plan(layout.spread(docs, "doc_id"))
    monkeypatch.setattr(layout, "SPREAD_BYTES_PER_CORE", 0)
    assert "Exchange" not in plan(layout.spread(docs, "doc_id"))
    assert docs.agg(F.count(F.lit(1))).first()[0] == 200
