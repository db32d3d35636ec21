"""Incremental ingest: new files become committed batches of the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from wordloom.plans.ingest import ingest_batch, ingest_pages
from wordloom.plans.store import VocabularyStore
from wordloom.schemas import DOCUMENTS, PAGES


def stream_documents(
    spark: SparkSession,
    path: str,
    pattern: str = "*.parquet",
    schema: T.StructType = DOCUMENTS,
    files_per_batch: int | None = None,
    bytes_per_batch: str | None = None,
) -> DataFrame:
    """``(source_id, text)`` of the document files in a folder, present and future.

    The two limits say how much one batch, and so one commit, may hold.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path).select(F.col("doc_id").alias("source_id"), "text")


def stream_pages(
    spark: SparkSession, path: str, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """``(page_id, url, html)`` of the page files in a folder, present and future."""
    reader = spark.readStream.schema(PAGES).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query when its checkpoint was made."""
    text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata")
    return text.select(F.get_json_object("value", "$.id")).first()[0]


def _start(
    store: VocabularyStore, rows: DataFrame, checkpoint: str, ingest: Callable, trigger: dict | None, options: dict
) -> StreamingQuery:
    """The checkpoint says which files a batch holds and names the stream, so a batch that failed, or whose
    driver was lost, runs again under the same key with the same files. If the store has committed it by then
    nothing is written. A failing batch stops the query; nothing after it moves the progress on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest(store, batch, batch_id=batch_id, stream=stream_name(store.spark, checkpoint), **options)

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_ingest(
    store: VocabularyStore, texts: DataFrame, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Start the ingest of texts. ``options`` are those of ``ingest_batch``."""
    return _start(store, texts, checkpoint, ingest_batch, trigger, options)


def start_page_ingest(
    store: VocabularyStore, pages: DataFrame, checkpoint: str, trigger: dict | None = None, **options
) -> StreamingQuery:
    """Start the ingest of pages. ``options`` are those of ``ingest_batch``."""
    return _start(store, pages, checkpoint, ingest_pages, trigger, options)
