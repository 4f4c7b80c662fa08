"""The archive sink of a live feed: idempotent epochs, flush periods by stream, a breaker for failing writes.

An epoch is one folder, ``epoch=<number>``, that a replayed batch writes over, and its commit marker (``_SUCCESS``) comes last.
Readers take marked epochs only.  All streams of a batch go out in one pass.

Writes that fail in a row are counted in a document beside the checkpoint, so the count outlives restarts.  At the bound the breaker is open:
the sink refuses to write until ``reset``, and a supervisor must not start it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidebook.sources import documents
from tidebook.sources.config import Config

#: Streams of few records, each of which should be on disk at once.
RARE = ("snapshots", "gaps", "outages", "malformed")
#: Seconds between the batches of rare streams.
RARE_SECONDS = 1.0


class BreakerOpen(RuntimeError):
    """Too many writes in a row have failed; the storage needs attention."""


class Breaker:
    """Failures in a row, in durable state."""

    def __init__(self, path: str, most: int = 50):
        self.path, self.most = f"{path}/breaker.json", most

    def failures(self) -> int:
        return (documents.read(self.path) or {}).get("failures", 0)

    def check(self) -> None:
        if (n := self.failures()) >= self.most:
            raise BreakerOpen(f"{n} writes in a row have failed")

    def record(self, error: Exception | None) -> None:
        before = self.failures()
        if error is not None:
            documents.write(self.path, {"failures": before + 1, "last": f"{type(error).__name__}: {error}"[:500]})
        elif before:
            documents.write(self.path, {"failures": 0})

    def reset(self) -> None:
        documents.write(self.path, {"failures": 0})


def write_epoch(batch: DataFrame, root: str, epoch: int, time_ns: str = "recv_ns") -> None:
    """One batch (value, stream, recv_ns) as stream/date/hour folders of gzip lines under its epoch, by ``time_ns``; writing it again changes nothing."""
    ts = F.timestamp_seconds(F.expr(f"{time_ns} div 1000000000"))
    rows = batch.select("value", "stream", F.date_format(ts, "yyyy-MM-dd").alias("date"), F.date_format(ts, "HH").alias("hour"))
    rows.write.mode("overwrite").partitionBy("stream", "date", "hour").option("compression", "gzip").text(f"{root}/epoch={epoch}")


def guarded(write: Callable[[DataFrame, int], None], breaker: Breaker) -> Callable[[DataFrame, int], None]:
    """``write`` behind a breaker."""

    def run(batch: DataFrame, epoch: int) -> None:
        breaker.check()
        try:
            write(batch, epoch)
        except Exception as error:
            breaker.record(error)
            breaker.check()
            raise
        breaker.record(None)

    return run


def start(rows: DataFrame, root: str, checkpoint: str, seconds: float | None = None, most_failures: int = 50, write: Callable[[DataFrame, str, int], None] = write_epoch) -> StreamingQuery:
    """Starts the sink over value, stream, recv_ns; a batch each ``seconds``, or all that is there and no more."""
    breaker = Breaker(checkpoint, most_failures)
    breaker.check()
    out = rows.writeStream.foreachBatch(guarded(lambda batch, epoch: write(batch, root, epoch), breaker)).option("checkpointLocation", f"{checkpoint}/log")
    return (out.trigger(availableNow=True) if seconds is None else out.trigger(processingTime=f"{seconds:g} seconds")).start()


def start_writers(rows: Callable[[], DataFrame], root: str, checkpoint: str, config: Config | None = None) -> list[StreamingQuery]:
    """Two sinks over the same feed, each with its own flush period: rare streams at once, the others each ``flush_seconds``.

    ``rows`` gives a new reader of the feed; each query keeps its own place in it.
    """
    config = config or Config()
    rare = F.col("stream").isin(*RARE)
    periods = (("rare", rare, RARE_SECONDS), ("dense", ~rare, config.flush_seconds))
    return [start(rows().where(keep), f"{root}/{name}", f"{checkpoint}/{name}", seconds, config.write_failures) for name, keep, seconds in periods]


def epochs(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the epochs with a commit marker."""
    found = [n.removeprefix("epoch=") for n in documents.names(root) if n.startswith("epoch=")]
    return sorted(int(n) for n in found if "_SUCCESS" in documents.names(f"{root}/epoch={n}"))


def read_epochs(spark: SparkSession, root: str) -> DataFrame:
    """epoch, stream, date, hour, value of all committed epochs."""
    schema = "value string, epoch long, stream string, date string, hour string"
    done = epochs(spark, root)
    # an epoch without rows has no folders inside
    places = [f"{root}/epoch={n}" for n in done if any(x.startswith("stream=") for x in documents.names(f"{root}/epoch={n}"))]
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).text(places)
