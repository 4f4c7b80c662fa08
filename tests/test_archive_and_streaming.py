from __future__ import annotations

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from tidebook.operators import book, gaps
from tidebook.sources import archive, config, fi2010, simulator, sinks
from tidebook.streaming import health, stateful


def envelope(n, pu, u, stream="x@depth"):
    return json.dumps({"t": n, "m": {"stream": stream, "data": {"e": "depthUpdate", "E": 10 + n, "s": "X", "U": pu + 1, "u": u, "pu": pu, "b": [["1.0", "2"]], "a": []}}})


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "depth" / "date=2024-01-01" / "hour=09"
    d.mkdir(parents=True)
    lines = [envelope(i, i, i + 1) for i in range(200)]
    packed = lambda part: gzip.compress(("\n".join(part) + "\n").encode(), mtime=0)
    (d / "depth-a.jsonl.gz").write_bytes(packed(lines[:100]))
    (d / "depth-b.jsonl.gz.part").write_bytes(packed(lines[100:150] + ["{broken"])[:-9])
    (d / "depth-b.jsonl.gz.part.orphan").write_bytes(packed(lines[150:]))
    (d / "depth-a.jsonl.gz.broken").write_bytes(packed(lines))
    return str(tmp_path)


def test_scan_reads_torn_files_and_no_backups(spark, root):
    assert [tuple(r)[:3] for r in archive.partitions(spark, root, "depth").collect()] == [("2024-01-01", 9, 3)]
    lines = archive.read_lines(spark, root, "depth")
    events = archive.in_order(archive.parse_depth(archive.good_json(lines)))
    got = events.orderBy("seq").collect()
    assert [r["final_id"] for r in got][:100] == list(range(1, 101)) and 190 < len(got) <= 200
    assert got[0]["first_id"] == 1 and got[0]["prev_id"] == 0 and got[0]["event_ms"] == 10 and got[0]["bids"] == [["1.0", "2"]]
    assert archive.read_sealed(spark, root, "depth").count() == 100
    report = {os.path.basename(r["path"]): (r["whole"], r["damaged"]) for r in archive.readability(spark, root, "depth").collect()}
    assert report["depth-a.jsonl.gz"] == (True, False) and report["depth-b.jsonl.gz.part"] == (False, False)


def test_salvage_walks_members():
    a, b = gzip.compress(b'{"a":1}\n'), gzip.compress(b'{"b":2}\n' * 50)
    data, members, damaged = archive.salvage(a + b"junk" + b)
    assert (data, members, damaged) == (b'{"a":1}\n' + b'{"b":2}\n' * 50, 2, 1)
    data, members, damaged = archive.salvage(a + b[:-12] + a)
    assert data.startswith(b'{"a":1}\n') and data.endswith(b'{"a":1}\n') and damaged >= 1


def test_routing_and_quarantine(spark):
    rows = [(envelope(1, 1, 2), "p", 0), (envelope(1, 1, 2, "x@aggTrade"), "p", 1), ("{nope", "p", 2)]
    df = spark.createDataFrame(rows, "value string, path string, line_no long")
    assert [r["stream"] for r in archive.route(df).orderBy("line_no").collect()] == ["depth", "trades", "malformed"]
    assert [r["raw"] for r in archive.malformed(df).collect()] == ["{nope"]


def test_archive_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(envelope(i, i, i + 1), "depth", 1_700_000_000_000_000_000 + i) for i in range(5)], "value string, stream string, recv_ns long")
    sinks.write_archive(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5


def test_trials_are_logged_before_and_after(spark, tmp_path):
    path = str(tmp_path / "trials")
    sinks.log_trial(spark, path, {"state": "started"})
    sinks.log_trial(spark, path, {"state": "started"})
    sinks.log_trial(spark, path, {"state": "finished"})
    assert tuple(sinks.trials(spark, path).first()) == (2, 1)


def test_dataset_manifest(spark, tmp_path):
    df = spark.createDataFrame([("x", 0, 0, 5), ("x", 0, 1, 6), ("x", 1, 2, 9)], "symbol string, segment_id long, seq long, event_ms long")
    r = sinks.write_dataset(df, str(tmp_path / "set")).first()
    assert (r["frames"], r["intervals"], r["longest"]) == (3, 2, 2)


def test_config_reads_values_without_comments():
    c = config.Config.from_env({"TIDEBOOK_TICK": "0.5  # half", "TIDEBOOK_SYMBOL": "# none", "TIDEBOOK_PURGE": "0", "TIDEBOOK_FOLDS": " 7 "})
    assert (c.tick, c.symbol, c.purge, c.folds) == (0.5, "btcusdt", 0, 7)


def test_wide_matrix(spark, tmp_path):
    n = 260
    rows = [[0.0] * n for _ in range(fi2010.ROWS)]
    rows[0], rows[2] = [100.1 + (900 if i >= 130 else i * 0.01) for i in range(n)], [99.9 + (900 if i >= 130 else i * 0.01) for i in range(n)]
    for k in range(5):
        rows[fi2010.FEATURES + k] = [float(1 + i % 3) for i in range(n)]
    path = tmp_path / "m.txt"
    path.write_text("\n".join("  ".join(f"{x:.4f}" for x in r) for r in rows))
    cells = fi2010.load_matrix(spark, str(path))
    fi2010.check_rows(cells)
    with pytest.raises(ValueError, match="rows, not 149"):
        fi2010.check_rows(cells.where("row < 5"))
    events = fi2010.segments(fi2010.joined([fi2010.events_of(cells), fi2010.events_of(cells)]))
    sizes = [r["count"] for r in events.groupBy("segment_id").count().orderBy("segment_id").collect()]
    assert sizes == [130, 130, 130, 130]
    labelled = fi2010.labels(fi2010.valid_rows(fi2010.returns(events), 50))
    assert labelled.count() == 4 * 30 and {r["y10"] for r in labelled.select("y10").distinct().collect()} == {0, 1, 2}


def run(query):
    query.processAllAvailable()
    health.drain(query)


def stream_of(spark, df, path, files=3, schema=None):
    for i in range(files):
        df.where(F.col("seq") % files == i if files == 1 else (F.col("part") == i)).write.mode("append").parquet(path)
    return spark.readStream.schema(schema or df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_replay_equals_batch(spark, tmp_path):
    es, ss = simulator.stream(spark, 2, 90, seed=4)
    lossy = es.where("seq % 40 <> 30")
    rows = stateful.union_stream(lossy, ss).coalesce(1).cache()
    for lo, hi in ((-1, 29), (30, 59), (60, 90)):
        rows.where(F.col("seq").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stateful.replay(source, simulator.TICK).writeStream.format("memory").queryName("books").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    run(q)
    columns = ["symbol", "seq", "outcome", "segment_id", "update_id", "bids", "asks"]
    got = sorted(tuple(r) for r in spark.table("books").select(columns).collect())
    want = sorted(tuple(r) for r in book.replay(lossy, ss, simulator.TICK).select(columns).collect())
    assert got == want


def test_streamed_gaps_equal_batch(spark, tmp_path):
    rows = [("x", 0, i, i * 10 + (5 if i == 7 else 0), (i - 1) * 10) for i in range(20) if i not in (4, 5)]
    df = spark.createDataFrame(rows, "symbol string, session_id long, seq long, final_id long, prev_id long")
    for lo in (0, 10):
        df.where(F.col("seq").between(lo, lo + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(stateful.gaps(source).writeStream.format("memory").queryName("gaps_out").outputMode("append").start())
    got = sorted((r["seq"], r["delta"], r["kind"]) for r in spark.table("gaps_out").collect())
    want = sorted((r["seq"], r["delta"], r["kind"]) for r in gaps.sequence_gaps(df, ["symbol", "session_id"]).collect())
    assert got == want and len(got) >= 2


def test_streamed_throttle(spark, tmp_path):
    df = spark.createDataFrame([("x", t) for t in (0, 3, 5, 9, 10, 11, 30)], "symbol string, at_ms long").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(stateful.throttle(source, 5).writeStream.format("memory").queryName("throttled").outputMode("append").start())
    assert sorted(r["at_ms"] for r in spark.table("throttled").collect()) == [0, 5, 10, 30]


def test_streamed_archive_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([(f"line {i}", "depth", 1_700_000_000 + 40 * i) for i in range(10)], "value string, stream string, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(stateful.archive(source, str(tmp_path / "out"), str(tmp_path / "c1")).start())
    assert spark.read.text(str(tmp_path / "out")).count() == 10
    run(stateful.minute_metrics(source).writeStream.format("memory").queryName("minutes").outputMode("complete").start())
    assert sum(r["n"] for r in spark.table("minutes").collect()) == 10


def test_faults_are_seeded(spark):
    es, _ = simulator.stream(spark, 1, 500, seed=9)
    a, b = (simulator.with_faults(es, drop=0.05, duplicate=0.05, seed=s).select("seq", "fault", "arrival").orderBy("arrival").collect() for s in (1, 1))
    assert a == b and 5 < sum(r["fault"] == "drop" for r in a) < 60 and len(a) > 500
