"""Streamed forms over several batches with restarts: processors with timers, the replay source, the sink and its breaker."""

from __future__ import annotations

import gzip
import os
import time

import pytest
from pyspark.sql import functions as F

from tidebook.operators import gaps
from tidebook.plans import streams
from tidebook.sources import archive, config, replay
from tidebook.streaming import sessions, sink


def test_streamed_gaps_with_reconnects_equal_batch(spark):
    rows, last = [], {}
    for i in range(120):
        symbol, kind = f"s{i % 3}", "connect" if i % 37 == 36 else "event"
        lost = 5 if i % 11 == 7 else -3 if i % 17 == 4 else 0
        prev = last.get(symbol, 0) + lost
        rows.append((symbol, i, kind, prev if kind == "event" else None, prev + 10 if kind == "event" else None, sum(r[0] == symbol and r[2] == "connect" for r in rows)))
        if kind == "event":
            last[symbol] = prev + 10
    df = spark.createDataFrame(rows, "symbol string, seq long, kind string, prev_id long, final_id long, session_id long")
    got = streams.fed(df.drop("session_id"), "seq", sessions.gaps, slices=4)
    want = gaps.sequence_gaps(df.where("kind = 'event'"), ["symbol", "session_id"])
    key = ["symbol", "seq", "expected_prev", "delta", "kind"]
    kinds = want.withColumn("kind", F.when(F.col("delta") > 0, "missing").otherwise("duplicate_or_reorder"))
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, kinds.select(key).collect())) and got.count() > 10


def test_streamed_outages_open_and_close_over_restarts(spark):
    marks = [("a", 10, "connect"), ("a", 20, "disconnect"), ("a", 25, "disconnect"), ("a", 60, "connect"), ("a", 70, "disconnect"), ("b", 5, "disconnect"), ("b", 90, "connect")]
    df = spark.createDataFrame(marks, "endpoint string, at_ns long, state string")
    out = [tuple(r) for r in streams.fed(df, "at_ns", sessions.outages, slices=3).collect()]
    assert sorted(r[:4] for r in out if r[1] == "closed") == [("a", "closed", 20, 60), ("b", "closed", 5, 90)]
    assert sorted(r[0:3] for r in out if r[1] == "open") == [("a", "open", 20), ("a", "open", 70), ("b", "open", 5)]


def test_a_stream_silent_on_the_wall_clock(spark, tmp_path):
    """Processing-time timers: the check goes off although nothing more arrives."""
    sessions.prepare(spark)
    rows = [("public", "depth", "expect"), ("public", "trades", "expect"), ("market", "agg", "expect"), ("public", "depth", "message")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "endpoint string, stream string, kind string, at_ms long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.missing_streams(source, 2_000, "ProcessingTime").writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        end = time.monotonic() + 90
        while spark.table("silent").count() < 2 and time.monotonic() < end:
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("silent").collect())) == [("market", "agg", "never_connected"), ("public", "trades", "silent")]


def test_requests_count_what_they_held_back(spark):
    rows = [("x", "message", 1_000_000), ("x", "gap", 1_001_000), ("x", "gap", 1_003_000), ("x", "gap", 1_007_000), ("x", "message", 1_100_000)]
    df = spark.createDataFrame(rows, "symbol string, kind string, at_ms long")
    run = lambda s: sessions.snapshot_requests(s.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", "1 seconds"), 30_000, 5_000)
    got = sorted(map(tuple, streams.fed(df, "at_ms", run, slices=2).collect()))
    assert got == [("x", 1_000_000, "connect", 0), ("x", 1_001_000, "gap", 0), ("x", 1_007_000, "gap", 1), ("x", 1_030_000, "periodic", 0), ("x", 1_060_000, "periodic", 0), ("x", 1_090_000, "periodic", 0)]


# -- the replay source -----------------------------------------------------------------------


def lines_of(spark, n=500, gap_ms=20_000):
    return spark.range(n).select(F.concat(F.lit("line "), "id").alias("value"), (F.lit(1_700_000_000_000_000_000) + F.col("id") * gap_ms * 1_000_000).alias("recv_ns"))


def test_replay_keeps_order_and_resumes(spark, tmp_path):
    root = str(tmp_path)
    replay.register(spark)
    replay.prepare(lines_of(spark), f"{root}/replay", 40)
    source = spark.readStream.format("archive_replay").option("path", f"{root}/replay").option("state", f"{root}/state").option("speed", 1e12).option("maxRecordsPerBatch", 130).load()
    out = streams.drained(source, root)
    rows = out.orderBy("batch", "hour", "line").collect()
    assert [r["value"] for r in rows] == [f"line {i}" for i in range(500)]
    sizes = [r["n"] for r in out.groupBy("batch").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) <= 130 and len(sizes) >= 4


def test_replay_is_paced_by_the_times_of_receipt(spark, tmp_path):
    root = str(tmp_path)
    replay.prepare(lines_of(spark, 100, 1_000), f"{root}/replay", 10)
    reader = replay.ReplayReader({"path": f"{root}/replay", "state": f"{root}/state", "speed": "100"})
    assert reader.latestOffset() == {"hour": "", "line": 0}  # nothing is due yet
    time.sleep(0.35)  # 35 seconds of the original
    early = reader.latestOffset()
    # another reader, as after a restart, goes on from the documents
    later = replay.ReplayReader({"path": f"{root}/replay", "state": f"{root}/state", "speed": "100"}).latestOffset()
    rows = sum(b.num_rows for p in reader.partitions(reader.initialOffset(), early) for b in reader.read(p))
    assert 20 <= rows <= 90 and rows % 10 == 0 and (later["hour"], later["line"]) >= (early["hour"], early["line"])
    replay.prepare(lines_of(spark, 0), f"{root}/none")
    assert replay.ReplayReader({"path": f"{root}/none", "state": f"{root}/none"}).latestOffset() == {"hour": "", "line": 0}


# -- the sink --------------------------------------------------------------------------------


def feed(spark, path, values, start=0):
    rows = [(v, "gaps" if i % 5 == 0 else "depth", 1_700_000_000_000_000_000 + i * 10**9) for i, v in enumerate(values, start)]
    spark.createDataFrame(rows, "value string, stream string, recv_ns long").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("value string, stream string, recv_ns long").parquet(path)


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    for part in (0, 1):
        source = feed(spark, f"{root}/in", [f"v{part}-{i}" for i in range(20)], 20 * part)
        sink.start(source, f"{root}/out", f"{root}/state").awaitTermination()
    commits = tmp_path / "state" / "log" / "commits"
    for name in ("1", ".1.crc"):
        (commits / name).unlink()  # the driver died before it could say that epoch 1 is done
    sink.start(source, f"{root}/out", f"{root}/state").awaitTermination()
    got = sink.read_epochs(spark, f"{root}/out")
    assert sorted(r["value"] for r in got.collect()) == sorted(f"v{p}-{i}" for p in (0, 1) for i in range(20))
    assert {r["stream"] for r in got.collect()} == {"gaps", "depth"} and sink.epochs(spark, f"{root}/out") == [0, 1]
    os.remove(f"{root}/out/epoch=1/_SUCCESS")  # an epoch without its marker isn't there
    assert got.count() == 40 and sink.read_epochs(spark, f"{root}/out").count() == 20


def test_the_breaker_opens_at_the_bound_and_stays_open(spark, tmp_path):
    root, calls = str(tmp_path), []

    def broken(batch, place, epoch):
        calls.append(epoch)
        raise OSError("no space")

    source = feed(spark, f"{root}/in", ["a", "b"])
    for i in range(3):
        with pytest.raises(Exception, match="no space" if i < 2 else "in a row"):
            sink.start(source, f"{root}/out", f"{root}/state", most_failures=3, write=broken).awaitTermination()
    with pytest.raises(sink.BreakerOpen, match="3 writes"):
        sink.start(source, f"{root}/out", f"{root}/state", most_failures=3)
    assert calls == [0, 0, 0]
    breaker = sink.Breaker(f"{root}/state", 3)
    breaker.reset()
    sink.start(source, f"{root}/out", f"{root}/state", most_failures=3).awaitTermination()
    assert breaker.failures() == 0 and sink.read_epochs(spark, f"{root}/out").count() == 2


def test_a_write_that_succeeds_closes_the_count(tmp_path):
    breaker = sink.Breaker(str(tmp_path), 5)
    for error in (OSError("x"), OSError("x"), None, OSError("x")):
        breaker.record(error)
    assert breaker.failures() == 1


def test_rare_streams_have_a_period_of_their_own(spark, tmp_path):
    root = str(tmp_path)
    feed(spark, f"{root}/in", [f"v{i}" for i in range(20)])
    read = lambda: spark.readStream.schema("value string, stream string, recv_ns long").parquet(f"{root}/in")
    began = time.monotonic()
    rare, dense = sink.start_writers(read, f"{root}/out", f"{root}/state", config.Config(flush_seconds=3_600))
    try:
        while sink.read_epochs(spark, f"{root}/out/dense").count() < 16 and time.monotonic() - began < 60:
            time.sleep(0.5)
        feed(spark, f"{root}/in", [f"w{i}" for i in range(20)])
        while sink.read_epochs(spark, f"{root}/out/rare").count() < 8 and time.monotonic() - began < 90:
            time.sleep(0.5)
        # a rare record is on disk at once; the dense ones of the second file wait for their period
        assert sink.read_epochs(spark, f"{root}/out/rare").count() == 8 and sink.read_epochs(spark, f"{root}/out/dense").count() == 16
    finally:
        rare.stop()
        dense.stop()


# -- files of dead writers -------------------------------------------------------------------


def test_orphans_are_set_aside_and_read_once(spark, tmp_path):
    hour = tmp_path / "depth" / "date=2024-01-01" / "hour=00"
    hour.mkdir(parents=True)
    line = lambda i: f'{{"t":{i},"m":{{}}}}\n'.encode()
    part = hour / "depth-20240101T000000Z.jsonl.gz.part"
    part.write_bytes(gzip.compress(line(1) + line(2))[:-8])
    (hour / "depth-20240101T000000Z.jsonl.gz").write_bytes(gzip.compress(line(0)))
    (hour / "empty.jsonl.gz.part").write_bytes(b"")
    assert archive.isolate(str(tmp_path), stale_s=3_600) == []
    (moved,) = archive.isolate(str(tmp_path))
    assert moved[1].endswith(".part.orphan") and not part.exists()
    part.write_bytes(gzip.compress(line(3))[:-8])  # a second writer dies too
    (again,) = archive.isolate(str(tmp_path))
    assert again[1].endswith(".part.orphan1")
    part.write_bytes(gzip.compress(line(4)))
    found = [r["value"] for r in archive.read_lines(spark, str(tmp_path), "depth").collect()]
    assert sorted(found) == sorted(line(i).decode().strip() for i in range(5))


def test_files_are_verified_once_and_again_when_they_change(spark, tmp_path):
    folder = tmp_path / "depth"
    folder.mkdir()
    for i in range(5):
        (folder / f"f{i}.jsonl.gz").write_bytes(gzip.compress(b"{}\n" * (i + 1))[: -8 if i == 3 else None])
    (folder / "g.jsonl.gz.part").write_bytes(b"unsealed")
    listed = lambda: spark.read.format("binaryFile").load(str(folder))
    state = str(tmp_path / "state")
    cycles = [[(os.path.basename(r["path"]), r["n_lines"], r["whole"]) for r in archive.verify_some(spark, listed(), state, 2).orderBy("path").collect()] for _ in range(4)]
    assert cycles == [[("f0.jsonl.gz", 1, True), ("f1.jsonl.gz", 2, True)], [("f2.jsonl.gz", 3, True), ("f3.jsonl.gz", 4, False)], [("f4.jsonl.gz", 5, True)], []]
    (folder / "f3.jsonl.gz").write_bytes(gzip.compress(b"{}\n" * 4))
    assert [r["whole"] for r in archive.verify_some(spark, listed(), state, 2).collect()] == [True]
