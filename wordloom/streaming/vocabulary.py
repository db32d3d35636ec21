"""The running vocabulary: counts, latest context and first contexts of every word, kept in keyed state.

The state of a (source, word) is what its batch views need and no more: the sum of its occurrences, the sentence
with the highest index, and the ``CONTEXTS`` different sentences with the lowest ones. Each of these can be merged
with what a new batch brings, whatever order sentences arrive in, so after any batch the
rows equal ``occurrence_counts``, ``latest_context`` and ``top_contexts`` over all that has arrived. State is some
hundred bytes a pair, however often the pair occurs; it lies in RocksDB on the executors and in the checkpoint.
A call of Python and its reads and writes of state cost milliseconds, so a key is not a pair but one of
``WORD_BUCKETS`` parts of a source's words; a batch reads and writes the parts that it touches.

Sentences that arrive again are dropped before they are tokenised, by their key. As there is no event time,
that key state grows with the sentences; an endless stream is better taken in by ``start_ingest``, which asks the
store, and followed by ``VocabularyStore.refresh``.

The sentences of one key in a batch meet in one task; words are counted inside the sentence before, and the
task reads them in pieces and holds five of a pair. ``files_per_batch`` bounds a batch. Checkpoints of the
earlier state, which had a key per pair, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from wordloom.operators.facts import spaced_facts
from wordloom.operators.sentences import split_sentences, with_sentence_id
from wordloom.operators.views import CONTEXTS
from wordloom.streaming.state import STORE_CLASS as STORE_CLASS  # where it was imported from before
from wordloom.streaming.state import rocksdb_state

STATE = (
    "pairs array<struct<word: string, n: long, last_idx: long, last_id: string,"
    " idxs: array<long>, ids: array<string>>>"
)
#: Keys that the words of one source are dealt to.
WORD_BUCKETS = 4


def merged_pair(state: tuple | None, sentences: Iterator[tuple[int, str, int]], limit: int = CONTEXTS) -> tuple:
    """The state of a pair after more ``(sentence_idx, sentence_id, n)``.

    A sentence that fell out of the lowest ones may come back with a lower index; as only
    the lowest index of a sentence counts, nothing that was dropped is missed.
    """
    n, last_idx, last_id, idxs, ids = state or (0, -1, None, [], [])
    first = dict(zip(ids, idxs, strict=True))
    for idx, sentence_id, more in sentences:
        n += more
        if idx > last_idx:
            last_idx, last_id = idx, sentence_id
        if idx < first.get(sentence_id, idx + 1):
            first[sentence_id] = idx
            if len(first) > limit:
                del first[max(first, key=first.__getitem__)]
    kept = sorted((idx, sentence_id) for sentence_id, idx in first.items())
    return n, last_idx, last_id, [i for i, _ in kept], [s for _, s in kept]


class RunningPairs(StatefulProcessor):
    """Keeps some words of a source; gives the row of each whenever a batch brings sentences of it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.words = handle.getValueState("words", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        states, touched = {}, {}
        if self.words.exists():
            for word, n, last_idx, last_id, idxs, ids in self.words.get()[0]:
                states[word] = (n, last_idx, last_id, list(idxs), list(ids))
        for part in rows:
            brought = {}
            columns = [part[c].tolist() for c in ("word", "sentence_idx", "sentence_id", "n")]
            for word, *sentence in zip(*columns, strict=True):
                brought.setdefault(word, []).append(sentence)
            for word, sentences in brought.items():
                states[word] = touched[word] = merged_pair(states.get(word), sentences)
        self.words.update(([(word, *state) for word, state in states.items()],))
        n, _, last_ids, idxs, ids = zip(*touched.values(), strict=True)
        yield pd.DataFrame(
            {"source_id": [key[0]] * len(n), "word": list(touched), "occurrence_count": n,
             "context_sentence_id": last_ids, "context_idxs": idxs, "context_ids": ids})

    def close(self) -> None:
        pass


def running_vocabulary(texts: DataFrame, part: str | None = None, drop_ascii: bool = True) -> DataFrame:
    """A row for every pair that a batch touched: counts, latest context, first contexts with their indexes.

    ``texts`` is a stream of ``source_id`` and ``text``; a source that spans rows names their order as ``part``.
    """
    sentences = split_sentences(texts, part=part).dropDuplicates(["source_id", "sentence_idx"])
    facts = spaced_facts(with_sentence_id(sentences), drop_ascii)
    source = texts.schema["source_id"].dataType
    row = T.StructType(
        [
            T.StructField("source_id", source),
            T.StructField("word", T.StringType()),
            T.StructField("occurrence_count", T.LongType()),
            T.StructField("context_sentence_id", T.StringType()),
            T.StructField("context_idxs", T.ArrayType(T.LongType())),
            T.StructField("context_ids", T.ArrayType(T.StringType())),
        ]
    )
    bucket = F.pmod(F.xxhash64("word"), F.lit(WORD_BUCKETS)).alias("bucket")
    keyed = facts.select("source_id", bucket, "word", "sentence_idx", "sentence_id", "n").groupBy("source_id", "bucket")
    return keyed.transformWithStateInPandas(RunningPairs(), row, "append", "none")


def start_running_vocabulary(
    rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the pairs that changed in each batch to a folder of that batch; a repeated batch overwrites its own."""

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    with rocksdb_state(rows.sparkSession):  # the only store that keeps state of one's own making
        return (
            rows.writeStream.outputMode("append")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(write)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def latest_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every pair."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in ("source_id", "word", "batch_id")]
    return rows.groupBy("source_id", "word").agg(F.max_by(F.struct(*fields), "batch_id").alias("row")).select(
        "source_id", "word", "row.*")


def first_contexts(vocabulary: DataFrame) -> DataFrame:
    """One row per pair and first context, numbered from 1, as ``top_contexts`` gives them."""
    pairs = F.arrays_zip(F.col("context_idxs").alias("idx"), F.col("context_ids").alias("id"))
    return vocabulary.select(
        "source_id", "word", "occurrence_count", "context_sentence_id", F.posexplode(pairs).alias("at", "c")
    ).select(
        "source_id", "word", "occurrence_count", "context_sentence_id", (F.col("at") + 1).cast("bigint").alias("context_no"),
        F.col("c.idx").alias("sentence_idx"), F.col("c.id").alias("sentence_id"))
