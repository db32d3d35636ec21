"""Partition layout and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scans below this many bytes per core are spread; larger ones keep the layout of their files.
SPREAD_BYTES_PER_CORE = 64 << 30
#: Estimated bytes of a scan that one task gets, and the most tasks a scan is spread over.
SPREAD_BYTES_PER_TASK, SPREAD_TASKS = 4 << 20, 20_000
#: Estimates from here on say that the size is not known.
UNKNOWN_BYTES = 1 << 60
#: Largest serialised size that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer estimate; for a plain file scan this is the size of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Split a scan over all cores, in tasks whose size does not grow with the input.

    A file with one row group is one task however large it is and however many cores there are,
    and text work is CPU bound. The text is shuffled once for that; what is grouped by all ``keys`` afterwards
    stays where it is, which saves a shuffle of the rows made of the text, many times its
    volume. Only an input far beyond the cores is returned as its files lie. The keys should be unique
    per row, so that no task gets more than its share and a retried task sees the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = estimated_bytes(df)
    if size >= UNKNOWN_BYTES and SPREAD_BYTES_PER_CORE:
        return df.repartition(*keys)  # a batch of a stream: AQE sees its size
    if size >= cores * SPREAD_BYTES_PER_CORE:
        return df
    return df.repartition(min(max(2 * cores, size // SPREAD_BYTES_PER_TASK), SPREAD_TASKS), *keys)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows as JSON text, found by an aggregation on the executors."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))).cast("bigint")
    return df.select(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether the rows may be sent to every executor.

    The optimizer's estimate is too low after an explode, so it may rule a broadcast
    out but not in: a side it finds small enough is measured.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    return estimated_bytes(df) <= limit and measured_bytes(df) <= limit


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """Without a hint a side is joined by shuffle, where AQE splits skewed partitions."""
    return F.broadcast(df) if small else df


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only for a side that was measured to be small."""
    return broadcast_if(is_small(df, limit), df)
