"""Reading the given tables, and tables that one job writes and the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.session import work_folder

#: Largest table, as JSON text, that is sent to every executor.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """The rows written to the shared folder and read back: no lineage to recompute."""
    path = work_folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(stored: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, hinted for broadcast if it was measured to be small; else joined by shuffle."""
    size = F.octet_length(F.to_json(F.struct(*stored.columns))).cast("bigint")
    small = (stored.agg(F.sum(size)).first()[0] or 0) <= limit
    return F.broadcast(stored) if small else stored


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns that an operator is about to add, whatever their case."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])
