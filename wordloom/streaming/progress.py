"""Progress of running streams, heard from Spark."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


class StreamProgress(StreamingQueryListener):
    """Tells of every batch that a stream has ended, and of the end of the stream.

    ``on_batch`` hears the stream's id, which is the name its commits have in the store, the number of
    the batch, the seconds it took and the rows its sources gave. ``on_end`` hears the id and the error, if
    any. Counts of sentences and links are heard by the batch job itself, while it writes
    (``on_batch`` and ``on_progress`` of ``ingest_batch``); both reach the log of this package.
    """

    def __init__(
        self,
        on_batch: Callable[[str, int, float, int], None] | None = None,
        on_end: Callable[[str, str | None], None] | None = None,
    ):
        self.on_batch, self.on_end = on_batch, on_end

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if not told.numInputRows:
            return
        seconds = told.batchDuration / 1000
        log.info("batch %s of %s: %s rows in %.1f s", told.batchId, told.id, told.numInputRows, seconds)
        if self.on_batch is not None:
            self.on_batch(str(told.id), told.batchId, seconds, told.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.log(logging.ERROR if event.exception else logging.INFO, "stream %s ended: %s", event.id, event.exception)
        if self.on_end is not None:
            self.on_end(str(event.id), event.exception)


def listen(spark: SparkSession, on_batch=None, on_end=None) -> StreamProgress:
    """Listen to all streams of the session until ``spark.streams.removeListener`` is given the result."""
    listener = StreamProgress(on_batch, on_end)
    spark.streams.addListener(listener)
    return listener
