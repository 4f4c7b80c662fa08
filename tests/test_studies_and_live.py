from __future__ import annotations

import http.server
import itertools
import socketserver
import threading

import pytest
from pyspark.sql import functions as F

from tidebook.operators import ml
from tidebook.plans import studies
from tidebook.sources import archive, fi2010, live, simulator


@pytest.fixture(scope="module")
def frames(spark):
    es, ss = simulator.stream(spark, 1, 900, seed=11)
    out = studies.build_frames(es, ss, simulator.TICK).cache()
    assert out.count() == 900
    return out


def test_evaluation_end_to_end(frames):
    got = studies.evaluate(frames, 5, n_folds=2, window=20, max_iter=5, multiplier=0.05).cache()
    assert {r["fold"] for r in got.select("fold").distinct().collect()} == {0, 1}
    by_fold, mean = studies.scores(got)
    assert by_fold.count() == 2 and 0 <= mean.first()["mean_macro_f1"] <= 1
    null = studies.evaluate(frames, 5, n_folds=2, window=20, max_iter=5, multiplier=0.05, columns=ml.RETURNS_ONLY, stride=3)
    assert null.count() == got.count()


def test_cost_floor(frames):
    edges, net = studies.cost_floor(frames, 5, latencies_ms=(0, 200), costs=(5.0,), block=10, resamples=80, n_folds=1, window=20, max_iter=5, multiplier=0.05)
    assert [r["ms"] for r in edges.orderBy("ms").collect()] == [0.0, 200.0]
    assert all(abs(r["net"] - (r["mean"] - 5)) < 1e-9 for r in net.collect())


def test_gap_study_and_inflation(spark):
    es, ss = simulator.stream(spark, 1, 400, seed=3)
    study = studies.gap_study(es, ss, simulator.TICK, rates=(0.02,), k=5, window=10, n_folds=1, max_iter=5, multiplier=0.05).cache()
    rows = {(r["rate"], r["arm"]): r for r in study.collect()}
    assert len(rows) == 3
    assert rows[0.02, "trusted"]["ends"] < rows[0.02, "naive"]["ends"]
    assert studies.inflation(study).count() == 1
    # nothing lost: the arms are one, and the twin rule keeps every end
    whole = studies.gap_study(es, ss, simulator.TICK, rates=(0.0,), k=5, window=10, least_ends=10_000).collect()
    assert len({r["ends"] for r in whole}) == 1


def test_refuses_to_report_on_few_ends(spark):
    es, ss = simulator.stream(spark, 1, 60, seed=3)
    assert all(r["macro_f1"] is None for r in studies.gap_study(es, ss, simulator.TICK, rates=(0.0,), k=5, window=10, least_ends=10_000).collect())


def test_label_report(frames):
    rows = studies.label_report(frames, (2, 5), [0.0, 1e9], window=20).collect()
    assert len(rows) == 4 and all(r["flag"] == "too flat" for r in rows if r["alpha"] == 1e9)
    assert all(abs(r["share_down"] + r["share_flat"] + r["share_up"] - 1) < 1e-9 for r in rows)


def test_counters(spark):
    es, ss = simulator.stream(spark, 1, 50, seed=3)
    assert {(r["outcome"], r["n"]) for r in studies.counters(es.where("seq <> 10"), ss).collect()} == {("applied", 10), ("desync", 1), ("unanchored", 38)}


def test_published_benchmark(spark, tmp_path):
    n = 400
    rows = [["0"] * n for _ in range(fi2010.ROWS)]
    rows[0], rows[2] = [f"{100.1 + (i % 17) * 0.01:.4f}" for i in range(n)], [f"{99.9 + (i % 17) * 0.01:.4f}" for i in range(n)]
    for k in range(5):
        rows[fi2010.FEATURES + k] = [str(1 + (i // 3) % 3) for i in range(n)]
    path = tmp_path / "m.txt"
    path.write_text("\n".join(" ".join(r) for r in rows))
    cells = fi2010.load_matrix(spark, str(path))
    out = {r["k"]: r for r in studies.published_benchmark(cells, [cells], horizons=(10, 30), max_iter=3).collect()}
    assert out[10]["published"] == 83.4 and out[30]["published"] is None


def test_snapshot_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"lastUpdateId": 7, "bids": [["1.0", "2"]], "asks": []}')

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    live.register(spark)
    lines = spark.read.format("rest_snapshot").option("url", f"http://127.0.0.1:{server.server_port}/").option("reason", "gap").load()
    row = archive.parse_snapshots(lines.withColumns({"path": F.lit(""), "line_no": F.lit(0)})).first()
    server.shutdown()
    assert row["update_id"] == 7 and row["reason"] == "gap" and row["recv_ns"] >= row["sent_ns"] and row["bids"] == [["1.0", "2"]]


def test_line_feed_reconnects():
    class Handler(socketserver.StreamRequestHandler):
        def handle(self):
            self.wfile.write(b"a\nb\nhalf")
            self.wfile.flush()

    server = socketserver.ThreadingTCPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    reader = live.LineReader({"host": "127.0.0.1", "port": str(server.server_address[1]), "wait": "0.4", "backoff": "0.01"})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    server.shutdown()
    assert len(rows) >= 4 and {v for _, v in rows} == {"a", "b"} and end["line"] == len(rows)
    assert list(reader.readBetweenOffsets({"line": 0}, end)) == rows
    reader.commit(end)
    assert reader.kept == {}


def test_backoff_grows_to_its_bound():
    waits = list(itertools.islice(live.backoff(1, 8, seed=0), 8))
    assert all(0.5 * min(8, 2**i) <= w <= min(8, 2**i) for i, w in enumerate(waits))
