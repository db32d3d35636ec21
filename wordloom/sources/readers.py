"""Pages, plain texts and dictionaries as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.schemas import ENTRY, ENTRY_OR_WRAPPER

# Fixed value: a page body of this many bytes or more is rejected.
MAX_PAGE_BYTES = 10 * 1024 * 1024


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def page_bytes() -> Column:
    return F.coalesce(F.octet_length("html"), F.lit(0))


def accepted_pages(pages: DataFrame, max_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """Pages below the size limit, whole. Larger ones are not cut, they are rejected."""
    return pages.where(page_bytes() < max_bytes)


def rejected_pages(pages: DataFrame, max_bytes: int = MAX_PAGE_BYTES) -> DataFrame:
    """The other pages, for quarantine."""
    return pages.where(page_bytes() >= max_bytes)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(source_id, text)`` from a table of documents."""
    return spark.read.parquet(path).select(F.col("doc_id").alias("source_id"), "text")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_dictionary(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Dictionary entries from JSON: ``{"words": [...]}``, a bare ``[...]``, or one entry.

    Published dictionaries are one JSON document over many lines, which a single task has
    to read. With ``multi_line=False`` every line is a document of its own in any of the
    three forms, and large files are split. Compressed files are read as they are. Text
    that is not such JSON fails the read, as does an object without entries; a bare
    empty array is a dictionary of none.
    """
    raw = spark.read.schema(ENTRY_OR_WRAPPER).json(path, multiLine=multi_line, mode="FAILFAST")
    entry = F.struct(*ENTRY.fieldNames())
    entries = (
        F.when(F.size("words") > 0, F.col("words"))
        .when(F.col("id").isNotNull(), F.array(entry))
        .otherwise(F.raise_error(F.lit("dictionary holds neither entries nor an entry list")))
    )
    return raw.select(F.explode(entries).alias("e")).select("e.*")
