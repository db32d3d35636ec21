"""Keyed state of the running vocabulary against the batch views."""

import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import views
from wordloom.operators.facts import spaced_facts
from wordloom.operators.sentences import split_sentences, with_sentence_id
from wordloom.streaming.vocabulary import (
    STORE_CLASS,
    first_contexts,
    latest_vocabulary,
    merged_pair,
    running_vocabulary,
    start_running_vocabulary,
)


@pytest.mark.parametrize("seed", range(20))
def test_state_equals_all_sentences_at_once(seed):
    rng = random.Random(seed)
    found = [(idx, f"s{rng.randrange(12)}", rng.randrange(1, 4)) for idx in rng.sample(range(200), rng.randrange(1, 60))]
    state, at = None, 0
    while at < len(found):
        upto = at + rng.randrange(1, 9)
        state = merged_pair(state, found[at:upto])
        at = upto
    first = {}
    for idx, name, _ in sorted(found):
        first.setdefault(name, idx)
    lowest = sorted((idx, name) for name, idx in first.items())[:5]
    assert state[0] == sum(n for *_, n in found)
    assert (state[1], state[2]) == max((idx, name) for idx, name, _ in found)
    assert (state[3], state[4]) == ([i for i, _ in lowest], [s for _, s in lowest])


def test_stream_over_restarts_equals_the_batch_views(spark, tmp_path, rows):
    kind = "source_id string, part long, text string"
    parts = [
        [("a", 3, "un deux\nun"), ("b", 0, "x"), ("c", 0, None), ("d", 0, "")],
        [("a", 0, "un\nun trois\ndeux un un"), ("a", 3, "un deux\nun"), (None, 0, "sans source")],
        [("a", 1, "un a\nun b\nun c\nun d"), ("b", 7, "x\ny x"), ("b", 0, "x")],
    ]
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("inbox", "out", "cp"))
    before = spark.conf.get(STORE_CLASS, None)
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(kind).parquet(inbox)
        start_running_vocabulary(running_vocabulary(stream, "part", drop_ascii=False), out, checkpoint).awaitTermination()
    assert spark.conf.get(STORE_CLASS, None) == before
    got = latest_vocabulary(spark, out)
    every = spark.createDataFrame([r for part in parts for r in part], kind).distinct()
    facts = spaced_facts(with_sentence_id(split_sentences(every, part="part")), False).cache()
    assert rows(got, "source_id", "word", "occurrence_count") == rows(views.occurrence_counts(facts))
    latest = views.latest_context(facts)
    assert rows(got, "source_id", "word", "context_sentence_id") == rows(latest, "source_id", "word", "context_sentence_id")
    columns = ["source_id", "word", "context_no", "sentence_idx", "sentence_id"]
    assert rows(first_contexts(got), *columns) == rows(views.top_contexts(facts), *columns)
    assert got.where((F.col("source_id") == "a") & (F.col("word") == "un")).first()["occurrence_count"] == 10
    # Nothing new: nothing changes.
    stream = spark.readStream.schema(kind).parquet(inbox)
    start_running_vocabulary(running_vocabulary(stream, "part", drop_ascii=False), out, checkpoint).awaitTermination()
    assert rows(latest_vocabulary(spark, out)) == rows(got)
