"""Live feeds by way of a spool: collectors write what arrives, a stream source reads it.

A collector holds one endpoint's connection (a websocket or plain lines).  Every line goes to the endpoint's open part
file with its time of receipt, and parts are sealed into segments by time or size: ``<first line>-<lines>.seg`` in the shared folder.  The
source's offsets are positions in that spool, so a line is durable before any offset covers it, and a batch that is
run again reads the same segments: nothing is lost or doubled whenever the driver or an executor ends.

Connections are recycled before the other side closes them: the new one is open before the old one goes, and what both
deliver is told apart by update id.  A lost connection is tried again after pauses that double, and both ends of the outage are in the spool.

The source admits ``maxRecordsPerBatch`` lines to a batch, shared over the endpoints; the rest waits in the spool, and how much waits is
written beside the admitted position.  After a driver died between that and Spark's own log, one batch may hold up to twice as many.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import socket
import ssl
import struct
import threading
import time
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidebook.sources import documents
from tidebook.sources.live import backoff

LINE = "endpoint string, line long, recv_ns long, kind string, value string"
SEGMENT = re.compile(r"(\d{20})-(\d{9})\.seg\Z")
UPDATE_ID = re.compile(r'"u":(\d+)')


class Lines:
    """A connection that carries one message a line."""

    def __init__(self, host: str, port: int, timeout: float):
        self.socket, self.rest = socket.create_connection((host, port), timeout=timeout), b""

    def receive(self, wait: float) -> list[str]:
        """Messages that came within ``wait`` seconds; OSError once the other side is gone."""
        self.socket.settimeout(wait)
        try:
            data = self.socket.recv(1 << 16)
        except TimeoutError:
            return []
        if not data:
            raise OSError("closed")
        return self.feed(data)

    def feed(self, data: bytes) -> list[str]:
        *lines, self.rest = (self.rest + data).split(b"\n")
        return [x.decode("utf-8", "replace") for x in lines if x]

    def close(self) -> None:
        self.socket.close()


class WebSocket(Lines):
    """Client side of RFC 6455: text and binary messages in, pings answered."""

    def __init__(self, url: str, timeout: float):
        at = urlparse(url)
        secure = at.scheme == "wss"
        super().__init__(at.hostname, at.port or (443 if secure else 80), timeout)
        if secure:
            self.socket = ssl.create_default_context().wrap_socket(self.socket, server_hostname=at.hostname)
        key = base64.b64encode(os.urandom(16)).decode()
        path = (at.path or "/") + (f"?{at.query}" if at.query else "")
        self.socket.sendall(f"GET {path} HTTP/1.1\r\nHost: {at.netloc}\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: {key}\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        head = b""
        while b"\r\n\r\n" not in head:
            data = self.socket.recv(4_096)
            if not data:
                raise OSError("closed in the handshake")
            head += data
        head, self.rest = head.split(b"\r\n\r\n", 1)
        accept = base64.b64encode(hashlib.sha1(f"{key}258EAFA5-E914-47DA-95CA-C5AB0DC85B11".encode()).digest())
        if b" 101 " not in head.split(b"\r\n", 1)[0] + b" " or accept not in head:
            raise OSError("no websocket")
        self.message = b""

    def feed(self, data: bytes) -> list[str]:
        self.rest += data
        out = []
        while (found := self.frame()) is not None:
            last, kind, body = found
            if kind == 8:
                raise OSError("closed")
            if kind == 9:
                self.send(10, body)
            elif kind in (0, 1, 2):
                self.message += body
                if last:
                    out.append(self.message.decode("utf-8", "replace").replace("\n", " "))
                    self.message = b""
        return out

    def frame(self) -> tuple[bool, int, bytes] | None:
        """(final, kind, body) of the next whole frame, taken from what has come."""
        d = self.rest
        if len(d) < 2:
            return None
        size, at = d[1] & 127, 2
        if size > 125:
            wide = 2 if size == 126 else 8
            if len(d) < 2 + wide:
                return None
            size, at = struct.unpack(">H" if wide == 2 else ">Q", d[2 : 2 + wide])[0], 2 + wide
        mask = d[at : at + 4] if d[1] & 128 else b""
        at += len(mask)
        if len(d) < at + size:
            return None
        body = d[at : at + size]
        self.rest = d[at + size :]
        return bool(d[0] & 128), d[0] & 15, masked(body, mask) if mask else body

    def send(self, kind: int, body: bytes) -> None:
        mask = os.urandom(4)
        self.socket.sendall(bytes([128 | kind, 128 | min(len(body), 125)]) + mask + masked(body[:125], mask))


def masked(body: bytes, mask: bytes) -> bytes:
    return bytes(b ^ mask[i % 4] for i, b in enumerate(body))


def connect(url: str, timeout: float) -> Lines:
    at = urlparse(url)
    return WebSocket(url, timeout) if at.scheme in ("ws", "wss") else Lines(at.hostname, at.port, timeout)


class Segments:
    """One endpoint's spool: an open part, sealed segments."""

    def __init__(self, root: str, endpoint: str, roll_lines: int, roll_s: float):
        self.files, base = documents.store(root)
        self.folder = f"{base}/endpoint={endpoint}"
        self.roll_lines, self.roll_s = roll_lines, roll_s
        self.files.create_dir(self.folder, recursive=True)
        self.part = f"{self.folder}/open.part"
        sealed = [m for n in documents.names(self.folder) if (m := SEGMENT.match(n))]
        self.first = max((int(m[1]) + int(m[2]) for m in sealed), default=0)
        self.stream, self.n, self.since = None, 0, 0.0
        self.recover()

    def recover(self) -> None:
        """Seals the whole lines of a part that a dead collector left."""
        if "open.part" in documents.names(self.folder):
            with self.files.open_input_stream(self.part) as f:
                whole = f.read().rpartition(b"\n")[0]
            if whole:
                self.add([line.decode().split("\t", 2) for line in whole.split(b"\n")], part=f"{self.folder}/recovered.part")
                self.seal()
            self.files.delete_file(self.part)

    def add(self, rows, part: str | None = None) -> None:
        if self.stream is None:
            self.open = part or self.part
            self.stream, self.since = self.files.open_output_stream(self.open), time.monotonic()
        self.stream.write("".join(f"{at}\t{kind}\t{value}\n" for at, kind, value in rows).encode())
        self.stream.flush()
        self.n += len(rows)

    def due(self) -> bool:
        return self.stream is not None and (self.n >= self.roll_lines or time.monotonic() - self.since >= self.roll_s)

    def seal(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.files.move(self.open, f"{self.folder}/{self.first:020d}-{self.n:09d}.seg")
            self.first, self.stream, self.n = self.first + self.n, None, 0


def write_segments(lines: DataFrame, root: str, roll_lines: int = 10_000) -> None:
    """Spools stored lines (endpoint, line, recv_ns, kind, value; lines of an endpoint numbered from 0) as segments, each by one task."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line")
        files, base = documents.store(root)
        folder = f"{base}/endpoint={pdf.endpoint.iloc[0]}"
        files.create_dir(folder, recursive=True)
        name = f"{int(pdf.line.iloc[0]):020d}-{len(pdf):09d}"
        part = f"{folder}/{name}.{os.urandom(4).hex()}"  # a task that is run again writes the same segment
        with files.open_output_stream(part) as f:
            f.write("".join(f"{at}\t{kind}\t{value}\n" for at, kind, value in zip(pdf.recv_ns, pdf.kind, pdf.value, strict=True)).encode())
        files.move(part, f"{folder}/{name}.seg")
        return pd.DataFrame({"n": [len(pdf)]})

    rows = lines.select("endpoint", "line", "recv_ns", "kind", "value", F.floor(F.col("line") / roll_lines).alias("segment"))
    rows.groupBy("endpoint", "segment").applyInPandas(write, "n long").agg(F.sum("n")).collect()


class Collector(threading.Thread):
    """Keeps one endpoint's connection and spools what it delivers, until ``stop``."""

    def __init__(self, root: str, endpoint: str, url: str, roll_lines: int = 10_000, roll_s: float = 1.0, recycle_s: float = 72_000.0, first_pause: float = 1.0, timeout: float = 10.0):
        super().__init__(daemon=True, name=f"collector-{endpoint}")
        self.segments = Segments(root, endpoint, roll_lines, roll_s)
        self.url, self.recycle_s, self.first_pause, self.timeout = url, recycle_s, first_pause, timeout
        self.ending, self.last_id, self.overlap = threading.Event(), None, False

    def run(self) -> None:
        pauses, down = backoff(self.first_pause), False
        while not self.ending.is_set():
            try:
                link = connect(self.url, self.timeout)
            except OSError:
                self.ending.wait(next(pauses))
                continue
            pauses = backoff(self.first_pause)
            self.mark("connect")
            self.last_id, self.overlap = None, False
            try:
                self.follow(link)
            except OSError:
                pass
            link = None
            down = not self.ending.is_set()
            if down:
                self.mark("disconnect")
                self.ending.wait(next(pauses))
        self.segments.seal()

    def stop(self) -> None:
        self.ending.set()
        self.join()

    def follow(self, link: Lines) -> None:
        """Spools a connection's lines; a new connection takes over when it is old."""
        since = time.monotonic()
        try:
            while not self.ending.is_set():
                self.take(link.receive(min(0.1, self.segments.roll_s)))
                if time.monotonic() - since >= self.recycle_s:
                    old, link = link, self.replaced(link)
                    if link is not old:
                        since = time.monotonic()
        finally:
            link.close()

    def replaced(self, old: Lines) -> Lines:
        """A new connection, once the old one has delivered all that came before the new one's first line."""
        try:
            new = connect(self.url, self.timeout)
        except OSError:
            return old
        try:
            head: list[str] = []
            until = time.monotonic() + self.timeout
            while not head and time.monotonic() < until:
                head = new.receive(0.05)
                self.take(old.receive(0.05))
            begins = min((i for i in map(update_id, head) if i is not None), default=None)
            while begins is not None and (self.last_id is None or self.last_id < begins) and time.monotonic() < until:
                came = old.receive(0.05)
                self.take(came)
        except OSError:  # the old side is gone already; the new one goes on
            pass
        old.close()
        self.overlap = True
        self.take(head)
        return new

    def take(self, lines: list[str]) -> None:
        now, rows = time.time_ns(), []
        for line in lines:
            i = update_id(line)
            if i is not None:
                if self.overlap and self.last_id is not None:
                    if i <= self.last_id:
                        continue  # the old connection has delivered it
                    self.overlap = False
                self.last_id = i
            rows.append((now, "message", line))
        if rows:
            self.segments.add(rows)
        if self.segments.due():
            self.segments.seal()

    def mark(self, kind: str) -> None:
        self.segments.add([(time.time_ns(), kind, "")])


def update_id(line: str) -> int | None:
    found = UPDATE_ID.search(line)
    return int(found[1]) if found else None


class Spool(DataSource):
    """``readStream.format("line_spool").option("path", ..).option("state", ..).option("maxRecordsPerBatch", ..)``."""

    @classmethod
    def name(cls) -> str:
        return "line_spool"

    def schema(self) -> str:
        return LINE

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return SpoolReader(self.options)


class Piece(InputPartition):
    """Lines ``start`` to ``stop`` of an endpoint, in one segment that begins at ``first``."""

    def __init__(self, endpoint: str, path: str, first: int, start: int, stop: int):
        self.endpoint, self.path, self.first, self.start, self.stop = endpoint, path, first, start, stop


class SpoolReader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.state = options["path"], f"{options['state']}/admitted.json"
        self.most = int(options.get("maxRecordsPerBatch", options.get("maxrecordsperbatch", "200000")))
        self.purge = options.get("purge", "false") == "true"

    def segments(self) -> dict[str, list[tuple[int, int, str]]]:
        """(first line, lines, path) of each endpoint's segments, by listing only."""
        found = {}
        for folder in documents.names(self.root):
            if folder.startswith("endpoint="):
                place = f"{self.root}/{folder}"
                found[folder.removeprefix("endpoint=")] = [(int(m[1]), int(m[2]), f"{place}/{m[0]}") for n in documents.names(place) if (m := SEGMENT.match(n))]
        return found

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        known = documents.read(self.state) or {"admitted": {}}
        at = known["admitted"]
        ends = {e: s[-1][0] + s[-1][1] for e, s in self.segments().items() if s}
        waiting = {e: end - at.get(e, 0) for e, end in ends.items()}
        share = admitted(waiting, self.most)
        at = at | {e: at.get(e, 0) + n for e, n in share.items() if n}
        left = sum(waiting.values()) - sum(share.values())
        if at != known["admitted"] or left != known.get("backlog"):
            documents.write(self.state, {"admitted": at, "backlog": left})
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for endpoint, found in self.segments().items():
            a, b = start.get(endpoint, 0), end.get(endpoint, 0)
            out += [Piece(endpoint, path, first, max(a, first), min(b, first + n)) for first, n, path in found if first < b and first + n > a]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files, path = documents.store(partition.path)
        with files.open_input_stream(path) as f:
            lines = f.read().split(b"\n")[partition.start - partition.first : partition.stop - partition.first]
        cells = [line.decode().split("\t", 2) for line in lines]
        n = len(cells)
        at, kind, value = zip(*cells, strict=True) if cells else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([partition.endpoint] * n, pa.string()), pa.array(range(partition.start, partition.start + n), pa.int64()), pa.array(map(int, at), pa.int64()), pa.array(kind, pa.string()), pa.array(value, pa.string())], names=["endpoint", "line", "recv_ns", "kind", "value"])

    def commit(self, end: dict) -> None:
        if self.purge:
            for endpoint, found in self.segments().items():
                for first, n, path in found[:-1]:  # the last one says where the spool stands
                    if first + n <= end.get(endpoint, 0):
                        files, place = documents.store(path)
                        files.delete_file(place)


def admitted(waiting: dict[str, int], most: int) -> dict[str, int]:
    """How many of each endpoint's waiting lines go into a batch of ``most``: even shares, what one leaves goes to the others."""
    out, left = {}, most
    for i, (endpoint, n) in enumerate(sorted(waiting.items(), key=lambda x: (x[1], x[0]))):
        out[endpoint] = min(n, left // (len(waiting) - i))
        left -= out[endpoint]
    return out


def backlog(state: str) -> int:
    """Lines that waited in the spool when the latest batch was planned."""
    return (documents.read(f"{state}/admitted.json") or {}).get("backlog", 0)


def register(spark) -> None:
    spark.dataSource.register(Spool)
