"""Liveness of streaming queries: a heartbeat from progress events, a supervisor, a failure breaker."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener


class Heartbeat(StreamingQueryListener):
    """Keeps the latest document: time, rows, whether every query is well."""

    def __init__(self, sink: Callable[[str], None] | None = None):
        self.sink, self.failures, self.document = sink, 0, {}

    def _beat(self, **fields) -> None:
        self.document = self.document | fields | {"t": time.time_ns(), "healthy": self.failures == 0}
        if self.sink:
            self.sink(json.dumps(self.document, sort_keys=True))

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._beat(started=str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._beat(rows=event.progress.numInputRows, batch=event.progress.batchId)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._beat(idle=True)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.failures += bool(event.exception)
        self._beat(ended=str(event.id))


def supervise(start: Callable[[], StreamingQuery], most_failures: int = 50, pause_s: float = 1.0) -> None:
    """Starts a query again after each failure, until it ends well or has failed ``most_failures`` times in a row without a batch."""
    failed = 0
    while True:
        query = start()
        try:
            query.awaitTermination()
            return
        except Exception:
            failed = 0 if query.lastProgress else failed + 1
            if failed >= most_failures:
                raise
            time.sleep(pause_s)


def drain(query: StreamingQuery) -> None:
    """Ends a query after all that has arrived is written."""
    query.processAllAvailable()
    query.stop()
