"""Running occurrence counts of an unbounded stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from wordloom.operators.facts import vocabulary_tokens
from wordloom.operators.sentences import split_sentences
from wordloom.operators.tokens import tokenize_spaced
from wordloom.operators.views import occurrence_counts
from wordloom.streaming.state import rocksdb_state


def running_counts(texts: DataFrame, drop_ascii: bool = True) -> DataFrame:
    """Counts per source and word; a sentence that arrives twice counts once.

    The de-duplication comes before tokenising, so its state holds sentence keys, not
    words. There is no event time, hence the state only grows: use it for bounded
    streams, and ``start_ingest``, which checks the store instead, for endless ones.
    """
    sentences = split_sentences(texts).dropDuplicates(["source_id", "sentence_idx"])
    return occurrence_counts(vocabulary_tokens(tokenize_spaced(sentences), drop_ascii))


def start_running_counts(
    counts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the counts that changed in each batch to a folder of that batch.

    State grows with sentences and pairs, so it lies in RocksDB, not in the heap of the executors.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    with rocksdb_state(counts.sparkSession):
        return (
            counts.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .foreachBatch(write)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every source and word."""
    return (
        spark.read.parquet(path)
        .groupBy("source_id", "word")
        .agg(F.max_by("occurrence_count", "batch_id").alias("occurrence_count"))
    )
