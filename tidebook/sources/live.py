"""Live sources as Spark data sources: REST snapshots, and a reconnecting line feed.

The feed's transport is a plain TCP line protocol; a gateway in front of a websocket speaks it.  Spark's micro-batches
give back-pressure, the offset log gives replay, and reconnects back off with jitter.
"""

from __future__ import annotations

import json
import random
import socket
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def backoff(first: float = 1.0, most: float = 60.0, seed: int | None = None) -> Iterator[float]:
    """Waits that double up to ``most``, each cut by a random half."""
    rng, wait = random.Random(seed), first
    while True:
        yield wait * (0.5 + rng.random() / 2)
        wait = min(most, wait * 2)


class SnapshotSource(DataSource):
    """``format("rest_snapshot").option("url", ..).option("reason", ..)``: one envelope of a depth snapshot."""

    @classmethod
    def name(cls) -> str:
        return "rest_snapshot"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return SnapshotReader(self.options)


class SnapshotReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.reason, self.timeout = options["url"], options.get("reason", "periodic"), float(options.get("timeout", "10"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple[str]]:
        sent = time.time_ns()
        with urllib.request.urlopen(self.url, timeout=self.timeout) as response:
            body = response.read().decode()
        # the document goes in as it came
        yield (f'{{"t":{time.time_ns()},"sent":{sent},"reason":{json.dumps(self.reason)},"m":{body}}}',)


class LineFeed(DataSource):
    """``readStream.format("line_feed").option("host", ..).option("port", ..)``: recv_ns and line, in batches of ``batch`` lines."""

    @classmethod
    def name(cls) -> str:
        return "line_feed"

    def schema(self) -> str:
        return "recv_ns long, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return LineReader(self.options)


class LineReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.address = (options["host"], int(options["port"]))
        self.batch, self.wait = int(options.get("batch", "10000")), float(options.get("wait", "0.5"))
        self.connection, self.rest, self.kept = None, b"", {}
        self.pauses = backoff(float(options.get("backoff", "1")))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows: list[tuple] = []
        until = time.monotonic() + self.wait
        while len(rows) < self.batch and time.monotonic() < until:
            try:
                if self.connection is None:
                    self.connection = socket.create_connection(self.address, timeout=self.wait)
                    self.rest = b""
                data = self.connection.recv(1 << 16)
                if not data:
                    raise OSError("closed")
            except TimeoutError:
                continue
            except OSError:
                self.connection = None
                time.sleep(min(next(self.pauses), max(0.0, until - time.monotonic())))
                continue
            *lines, self.rest = (self.rest + data).split(b"\n")
            now = time.time_ns()
            rows += [(now, line.decode("utf-8", "replace")) for line in lines if line]
        end = {"line": start["line"] + len(rows)}
        self.kept[start["line"]] = (rows, end["line"])
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        out, at = [], start["line"]
        while at < end["line"] and at in self.kept:
            rows, at = self.kept[at]
            out += rows
        return iter(out)

    def commit(self, end: dict) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k >= end["line"]}


def register(spark) -> None:
    spark.dataSource.register(SnapshotSource)
    spark.dataSource.register(LineFeed)
