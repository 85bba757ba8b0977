"""MON-09: scheduled evaluation with back-off.

A query runs with a processing-time trigger.  A listener counts its errors in a row; from
``MAX_ERRORS`` on the next runs wait twice as long, until a batch succeeds."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

MAX_ERRORS = 3        # errors in a row from which the wait doubles (fixed value)
BACK_OFF = 2


class ErrorCount(StreamingQueryListener):
    """Errors in a row of the runs of one named query."""

    def __init__(self, name: str):
        self.name, self.errors, self.batches = name, 0, 0
        self._runs: set[str] = set()
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._change:
            if event.name == self.name:
                self._runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        with self._change:
            if event.progress.name == self.name:
                self.errors, self.batches = 0, self.batches + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._change:
            if str(event.runId) in self._runs:
                self.errors += event.exception is not None
                self._ended.add(str(event.runId))
                self._change.notify_all()

    def wait_for(self, run: str, timeout: float = 30.0) -> None:
        """Until the events of a run that has ended are in (they come a little later)."""
        with self._change:
            self._change.wait_for(lambda: run in self._ended, timeout)

    def interval(self, seconds: float) -> float:
        return seconds * (BACK_OFF if self.errors >= MAX_ERRORS else 1)


def keep_running(spark: SparkSession, name: str, start: Callable[[str], StreamingQuery], seconds: float,
                 stop: threading.Event, waits: list[float] | None = None) -> ErrorCount:
    """Start a query again and again until ``stop`` is set.

    ``start`` gets the trigger's interval ("5.0 seconds") and starts the query called ``name``; it goes on
    from its checkpoint.  ``waits`` receives the pause before each new start."""
    count = ErrorCount(name)
    spark.streams.addListener(count)
    try:
        while not stop.is_set():
            query = start(f"{count.interval(seconds)} seconds")
            try:
                query.awaitTermination()
            except StreamingQueryException:
                pass                                   # counted by the listener
            count.wait_for(str(query.runId))
            pause = count.interval(seconds)
            if waits is not None:
                waits.append(pause)
            stop.wait(pause)
    finally:
        spark.streams.removeListener(count)
    return count
