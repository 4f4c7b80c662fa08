from __future__ import annotations

import base64
import hashlib
import json
import socket
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidebook.sources import config, documents, spool


class Feed(threading.Thread):
    """A server: each connection gets lines from where the feed stands, ``overlap`` older ones first."""

    def __init__(self, lines, web=False, overlap=0, drop_after=None, pause=0.002):
        super().__init__(daemon=True)
        self.lines, self.web, self.overlap, self.drop_after, self.pause = lines, web, overlap, drop_after, pause
        self.server = socket.create_server(("127.0.0.1", 0))
        self.url = f"{'ws' if web else 'tcp'}://127.0.0.1:{self.server.getsockname()[1]}/x"
        self.at, self.connections, self.lock = 0, 0, threading.Lock()
        self.start()

    def run(self):
        threading.Thread(target=self.tick, daemon=True).start()
        while True:
            link, _ = self.server.accept()
            self.connections += 1
            threading.Thread(target=self.serve, args=(link, self.connections), daemon=True).start()

    def tick(self):
        while not self.connections:
            time.sleep(0.01)
        time.sleep(0.1)
        while self.at < len(self.lines):
            self.at += 1
            time.sleep(self.pause)

    def serve(self, link, number):
        if self.web:
            head = b""
            while b"\r\n\r\n" not in head:
                head += link.recv(4_096)
            key = next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.startswith(b"Sec-WebSocket-Key"))
            accept = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest())
            link.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + accept + b"\r\n\r\n" + bytes([0x89, 2]) + b"hi")
        sent = 0 if number == 1 else max(0, self.at - self.overlap)
        try:
            while sent < len(self.lines):
                while sent < self.at:
                    link.sendall(self.framed(self.lines[sent].encode()))
                    sent += 1
                    if number == 1 and self.drop_after and sent >= self.drop_after:
                        link.close()
                        return
                time.sleep(0.001)
        except OSError:
            pass

    def framed(self, body):
        if not self.web:
            return body + b"\n"
        if len(body) > 125:
            return bytes([0x81, 126]) + struct.pack(">H", len(body)) + body
        # a message in two frames
        return bytes([0x01, 1]) + body[:1] + bytes([0x80, len(body) - 1]) + body[1:]


def lines(n, pad=0):
    return [json.dumps({"u": i, "x": "é" * pad}, separators=(",", ":")) for i in range(1, n + 1)]


def spooled(root, endpoint):
    reader = spool.SpoolReader({"path": root, "state": f"{root}-state"})
    found = reader.segments().get(endpoint, [])
    assert [f for f, _, _ in found] == [sum(n for _, n, _ in found[:i]) for i in range(len(found))]
    rows = [r for p in reader.partitions({}, {endpoint: 10**9}) for b in reader.read(p) for r in b.to_pylist()]
    assert [r["line"] for r in rows] == list(range(len(rows)))
    return rows


def until(condition, seconds=20):
    end = time.monotonic() + seconds
    while not condition():
        assert time.monotonic() < end
        time.sleep(0.02)


@pytest.mark.parametrize("web", [False, True])
def test_every_line_is_spooled_over_recycled_connections(tmp_path, web):
    want = lines(900, pad=100)
    feed = Feed(want, web=web, overlap=15)
    c = spool.Collector(str(tmp_path), "public", feed.url, roll_lines=50, roll_s=0.05, recycle_s=0.25)
    c.start()
    until(lambda: c.last_id == 900)
    c.stop()
    rows = spooled(str(tmp_path), "public")
    assert [r["value"] for r in rows if r["kind"] == "message"] == want
    assert feed.connections > 2 and [r["kind"] for r in rows].count("connect") == 1


def test_outages_are_marked(tmp_path):
    feed = Feed(lines(300), drop_after=40, overlap=0)
    c = spool.Collector(str(tmp_path), "market", feed.url, first_pause=0.05)
    c.start()
    until(lambda: c.last_id == 300)
    c.stop()
    kinds = [r["kind"] for r in spooled(str(tmp_path), "market") if r["kind"] != "message"]
    assert kinds == ["connect", "disconnect", "connect"]


def test_a_part_that_a_dead_collector_left_is_sealed(tmp_path):
    first = spool.Segments(str(tmp_path), "e", 10, 60)
    first.add([(1, "message", "a\tb"), (2, "message", "c")])
    first.stream.write(b"3\tmessage\ttor")  # dies inside a line
    first.stream.flush()
    spool.Segments(str(tmp_path), "e", 10, 60)
    assert [(r["recv_ns"], r["value"]) for r in spooled(str(tmp_path), "e")] == [(1, "a\tb"), (2, "c")]


def test_shares_of_a_batch():
    assert spool.admitted({"a": 5, "b": 100}, 40) == {"a": 5, "b": 35}
    assert spool.admitted({"a": 50, "b": 100}, 40) == {"a": 20, "b": 20}
    assert spool.admitted({}, 40) == {} and spool.admitted({"a": 0}, 3) == {"a": 0}


def started(spark, root, base, most):
    spool.register(spark)
    source = spark.readStream.format("line_spool").option("path", root).option("state", f"{base}/state").option("maxRecordsPerBatch", most).load()
    return source.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")


def test_batches_keep_to_the_limit_and_a_killed_driver_loses_nothing(spark, tmp_path):
    """The backlog falls batch by batch; the log of the last batch's commit is taken away, as if the driver had died before it."""
    root, base = str(tmp_path / "spool"), str(tmp_path)
    for endpoint, n in (("public", 130), ("market", 45)):
        s = spool.Segments(root, endpoint, 1_000, 60)
        for at in range(0, n, 20):
            s.add([(at + i, "message", f"{endpoint}-{at + i}") for i in range(min(20, n - at))])
            s.seal()
    seen = []
    q = started(spark, root, base, 40).start()
    try:
        until(lambda: q.lastProgress and sum(p["numInputRows"] for p in q.recentProgress) == 175, 60)
        seen = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    finally:
        q.stop()
    assert max(seen) <= 40 and len(seen) >= 5 and spool.backlog(f"{base}/state") == 0
    commits = sorted((int(p.name), p) for p in (tmp_path / "checkpoint" / "commits").iterdir() if p.name.isdigit())
    commits[-1][1].unlink()
    commits[-1][1].with_name(f".{commits[-1][1].name}.crc").unlink(missing_ok=True)
    s = spool.Segments(root, "public", 1_000, 60)
    s.add([(500 + i, "message", f"public-{130 + i}") for i in range(90)])
    s.seal()
    q = started(spark, root, base, 40).start()
    try:
        until(lambda: spark.read.parquet(f"{base}/out").count() == 265, 60)
        q.processAllAvailable()
        waits = spool.backlog(f"{base}/state")
    finally:
        q.stop()
    out = spark.read.parquet(f"{base}/out")
    assert waits == 0 and out.select("value").distinct().count() == out.count() == 265
    assert out.groupBy("endpoint").agg(F.count("*").alias("n"), F.max("line").alias("last")).orderBy("endpoint").collect() == [("market", 45, 44), ("public", 220, 219)]


def test_limit_comes_from_the_configuration():
    c = config.Config.from_env({"TIDEBOOK_QUEUE_RECORDS": "77"})
    assert spool.SpoolReader({"path": "/x", "state": "/y", **c.stream_options()}).most == 77


def test_documents(tmp_path):
    place = f"file://{tmp_path}/a/b.json"
    assert documents.read(place) is None
    documents.write(place, {"x": 1})
    documents.write(place, {"x": 2})
    assert documents.read(str(tmp_path / "a" / "b.json")) == {"x": 2} and documents.names(f"{tmp_path}/a") == ["b.json"]
