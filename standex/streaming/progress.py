"""Progress of streams: rows, batches, rate and time left, from Spark's own progress events."""

from __future__ import annotations

import logging
import threading
import time
from types import TracebackType

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent

#: Seconds that events may come after their stream has ended.
LATE = 30


class Progress(StreamingQueryListener):
    """Listens to a session's streams while it is entered, and logs each batch. With `total` rows known, says how
    much time is left. Events come from another thread, in order, and after the batch that they tell of."""

    def __init__(self, spark: SparkSession, log: logging.Logger | None = None, total: int | None = None) -> None:
        self.rows, self.batches, self.total = 0, 0, total
        self._spark, self._log, self._began = spark, log or logging.getLogger(__name__), time.monotonic()
        self._ended: dict[str, threading.Event] = {}
        self._lock = threading.Lock()

    def __enter__(self) -> Progress:
        self._began = time.monotonic()
        self._spark.streams.addListener(self)
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self._spark.streams.removeListener(self)

    def _end(self, run_id: object) -> threading.Event:
        with self._lock:
            return self._ended.setdefault(str(run_id), threading.Event())

    @property
    def rate(self) -> float:
        """Rows a second."""
        return self.rows / max(time.monotonic() - self._began, 1e-9)

    @property
    def seconds_left(self) -> float | None:
        """None where the total isn't known, or nothing has been read yet."""
        if self.total is None or not self.rows:
            return None
        return max(self.total - self.rows, 0) / self.rate

    def wait(self, stream: StreamingQuery) -> None:
        """Until the events of a stream that has ended have all come."""
        self._end(stream.runId).wait(LATE)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self._end(event.runId)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        if not event.progress.numInputRows:
            return
        self.rows += event.progress.numInputRows
        self.batches += 1
        left = self.seconds_left
        self._log.info("batch %d: %d rows, %.1f rows a second%s", event.progress.batchId, event.progress.numInputRows, self.rate, "" if left is None else f", {left:.0f} s left")

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._end(event.runId).set()
