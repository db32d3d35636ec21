"""Where streams keep their state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

STORE_CLASS = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: All stores of an executor share one cache and one budget of write buffers.
BOUNDED = "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep their state in RocksDB; a stream holds the settings it started with."""
    wanted = {STORE_CLASS: ROCKSDB, BOUNDED: "true"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
