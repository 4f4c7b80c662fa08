from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import book, cost, folds, frames, gaps, metrics, ml, quality
from tidebook.sources import simulator


@pytest.fixture
def walk(spark):
    rng = random.Random(0)
    rows, mid = [], 100.0
    for seg, n in ((0, 60), (1, 5), (2, 120)):
        for _ in range(n):
            mid *= math.exp(rng.gauss(0, 0.01))
            rows.append(("x", seg, len(rows), mid))
    return spark.createDataFrame(rows, "symbol string, segment_id long, seq long, mid double"), rows


def by_segment(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_windows_stay_in_their_segment(walk):
    df, rows = walk
    out = {r["seq"]: r for r in df.select("seq", frames.rolling_sum(F.col("mid"), 10).alias("s"), frames.lagged_return_bp(F.col("mid"), 10).alias("r"), frames.forward_bp(F.col("mid"), 7, 2).alias("f"), frames.smoothed_bp(F.col("mid"), 4).alias("m")).collect()}
    for seg in by_segment(rows).values():
        x = [r[3] for r in seg]
        for i, r in enumerate(seg):
            got = out[r[2]]
            assert got["s"] == pytest.approx(sum(x[max(0, i - 9) : i + 1]))
            assert got["r"] == pytest.approx(math.log(x[i] / x[i - 10]) * 1e4 if i >= 10 else 0.0, abs=1e-9)
            ok = i + 9 < len(x)
            assert got["f"] == (pytest.approx((np.mean(x[i + 3 : i + 10]) / x[i + 2] - 1) * 1e4, abs=1e-6) if ok else None)
            ok = i >= 3 and i + 4 < len(x)
            back = np.mean(x[i - 3 : i + 1]) if ok else 1
            assert got["m"] == (pytest.approx((np.mean(x[i + 1 : i + 5]) - back) / back * 1e4, abs=1e-6) if ok else None)


def test_long_sums_equal_plain_ones(walk):
    df, _ = walk
    a = frames.rolling_sums(df, {"s": (F.col("mid"), 30)}).withColumn("t", frames.rolling_sum(F.col("mid"), 30))
    assert all(r["s"] == pytest.approx(r["t"]) for r in a.collect())


def test_islands_by_bucket_equal_islands(walk):
    df, _ = walk
    flag = F.col("seq") % 7 == 3
    one = frames.island_ids(df, flag, ["symbol"], "seq", name="a")
    both = frames.island_ids(one, flag, ["symbol"], "seq", bucket=F.floor(F.col("seq") / 11), name="b")
    assert all(r["a"] == r["b"] for r in both.collect())


def test_valid_ends(walk):
    df, rows = walk
    got = {r["seq"] for r in frames.valid_ends(df, 20, 10, 3).collect()}
    want = {r[2] for seg in by_segment(rows).values() for i, r in enumerate(seg) if i >= 19 and i <= len(seg) - 14}
    assert got == want


def test_order_flow_matches_its_definition(spark):
    rng = random.Random(1)
    quotes = [("x", 0, i, 100 - rng.randint(0, 2) / 10, float(rng.randint(1, 9)), 100.1 + rng.randint(0, 2) / 10, float(rng.randint(1, 9))) for i in range(50)]
    df = spark.createDataFrame(quotes, "symbol string, segment_id long, seq long, b double, bq double, a double, aq double")
    got = [r["e"] for r in df.select("seq", frames.order_flow(*(F.col(c) for c in ("b", "bq", "a", "aq"))).alias("e")).orderBy("seq").collect()]
    assert got[0] == 0
    for p, q, e in zip(quotes, quotes[1:], got[1:], strict=False):
        want = (q[3] >= p[3]) * q[4] - (q[3] <= p[3]) * p[4] - (q[5] <= p[5]) * q[6] + (q[5] >= p[5]) * p[6]
        assert e == want


def test_features_are_causal(spark):
    es, ss = simulator.stream(spark, 1, 80, seed=2)
    states = book.split_layout(book.frame_layout(book.replay(es, ss, simulator.TICK)))
    whole = {r["seq"]: [r[f] for f in frames.FEATURES] for r in frames.features(states).collect()}
    part = {r["seq"]: [r[f] for f in frames.FEATURES] for r in frames.features(states.where("seq < 40")).collect()}
    assert len(frames.FEATURES) == 14 and len(whole) == 80
    assert all(part[k] == pytest.approx(whole[k]) for k in part)


def test_scalars(spark):
    row = spark.range(1).select(
        S.to_ticks(F.lit("63590.05"), 0.1).alias("up"), S.latency_frames(F.lit(250.0)).alias("even"), S.label_from_bp(F.lit(1.0), 1.0).alias("flat"), S.label_from_bp(F.lit(1.1), 1.0).alias("rise"),
        S.imbalance(F.lit(0.0), F.lit(0.0)).alias("empty"), S.gcd_of(F.array(*(F.lit(x).cast("long") for x in (50, 20, 30)))).alias("gcd"), S.recode_three(F.lit(1)).alias("one"),
        S.interpolate(F.lit(5.0), F.lit(0.0), F.lit(1.0), F.lit(10.0), F.lit(2.0)).alias("half"), S.human_bytes(F.lit(1536)).alias("kb"), S.period(F.lit(7300), 3600).alias("p"), S.depth_slope(F.array(F.lit(1.0), F.lit(3.0))).alias("slope"),
    ).first()
    assert tuple(row) == (635901, 2, 1, 2, 0.0, 10, 2, 1.5, "1.5 KB", 7200, 1.75)


def test_folds_purge_and_cover(spark):
    ends = spark.range(1000).select(F.col("id").alias("frame_id"), F.lit(1.0).alias("mid"), F.lit(0.2).alias("spread"))
    rows = folds.make_folds(ends, 4, 10).cache()
    assert folds.fold_edges(0, 999, 4) == [0, 200, 400, 600, 800, 1000]
    for f in range(4):
        mine = rows.where(F.col("fold") == f)
        train, test = (mine.where(F.col("role") == r).agg(F.min("frame_id"), F.max("frame_id")).first() for r in ("train", "test"))
        t0 = 200 * (f + 1)
        assert tuple(test) == (t0, t0 + 199) and train[1] + 10 < t0 - 10 and train[0] == 0
    assert rows.where("role = 'test'").select("frame_id").distinct().count() == 800
    assert folds.make_folds(ends, 4, 10, purge=0).where("role = 'train'").count() > rows.where("role = 'train'").count()
    assert {r["fold"] for r in folds.make_folds(ends, 4, 10, least_train=300).select("fold").distinct().collect()} == {1, 2, 3}
    assert folds.fold_alpha(rows, 2.0).first()["alpha"] == pytest.approx(2000.0)
    assert folds.make_folds(ends.where("frame_id < 0"), 4, 10).count() == 0


def test_statistics_use_training_rows_only(spark):
    rows = spark.createDataFrame([(0, "train", 1.0), (0, "train", 3.0), (0, "test", 1e6), (1, "train", 5.0)], "fold int, role string, x double")
    assert {tuple(r) for r in folds.fold_stats(rows, ["x"]).collect()} == {(0, 2.0, 1.0), (1, 5.0, 1.0)}


def test_weighted_and_macro_f1(spark):
    rows = [(1, 1)] * 90 + [(0, 1)] * 5 + [(2, 1)] * 5
    df = spark.createDataFrame(rows, "y int, p int")
    r = metrics.summary(metrics.class_scores(metrics.confusion(df))).first()
    assert r["weighted_f1"] == pytest.approx(0.9 * 1.8 / 1.9) and r["macro_f1"] == pytest.approx(1.8 / 1.9 / 3) and r["accuracy"] == r["majority"] == pytest.approx(0.9)
    one = spark.createDataFrame([(1, 1)], "y int, p int")
    assert metrics.summary(metrics.class_scores(metrics.confusion(one))).first()["macro_f1"] == pytest.approx(1 / 3)


def ar(phi, n=40_000, seed=0):
    rng = np.random.default_rng(seed)
    x, e = np.zeros(n), rng.normal(size=n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + e[i]
    return x


def width(x, length, seed=0):
    lo, hi = cost.bootstrap_mean(x, length, seed=seed)
    return (hi - lo) / (2 * 1.96 * x.std() / math.sqrt(len(x)))


def test_bootstrap_properties():
    assert 0.75 < width(ar(0.0), 200) < 1.35
    assert width(ar(0.9), 200) > 3
    assert width(ar(0.9), 5) < width(ar(0.9), 50) < width(ar(0.9), 400) * 1.2
    assert cost.bootstrap_mean(np.full(1234, 3.5), 100) == (3.5, 3.5)
    lo, hi = cost.bootstrap_mean(np.arange(10.0), 1000)
    assert lo == hi == 4.5
    assert all(map(math.isnan, cost.bootstrap_mean(np.ones(1), 5)))


def test_distributed_bootstrap(spark):
    rows = [("a", i, float(i % 7)) for i in range(500)] + [("b", 0, 1.0)]
    got = {r["symbol"]: r for r in cost.bootstrap(spark.createDataFrame(rows, "symbol string, seq long, edge double"), ["symbol"], 20, 400).collect()}
    assert got["a"]["n"] == 500 and got["a"]["lo"] < got["a"]["mean"] < got["a"]["hi"]
    assert got["b"]["n"] == 1 and got["b"]["lo"] is None


def test_edges_and_costs(spark):
    df = spark.createDataFrame([(2.0, 2), (-3.0, 0), (5.0, 1), (7.0, 0)], "bp double, p int")
    assert sorted(r["edge"] for r in cost.gross_edges(df).collect()) == [-7.0, 2.0, 3.0]
    summary = cost.edge_summary(df.withColumn("s", F.lit("x")), ["s"])
    assert summary.first()["trades"] == 3 and summary.first()["trade_rate"] == 0.75
    assert [round(r["net"], 6) for r in cost.net_edges(summary, [5.0, 10.0]).orderBy("cost").collect()] == [round(-2 / 3 - 5, 6), round(-2 / 3 - 10, 6)]


def test_sequence_gaps(spark):
    rows = [("x", 0, 0, 110, 99), ("x", 0, 1, 120, 110), ("x", 0, 2, 150, 140), ("x", 0, 3, 60, 50), ("x", 1, 4, 910, 899), ("x", 1, 5, 920, 910)]
    df = spark.createDataFrame(rows, "symbol string, session_id long, seq long, final_id long, prev_id long")
    got = [(r["seq"], r["delta"], r["kind"]) for r in gaps.sequence_gaps(df, ["symbol", "session_id"]).orderBy("seq").collect()]
    assert got == [(2, 20, "missing"), (3, -100, "duplicate_or_reorder")]


def test_sessions_from_connects(spark):
    es = spark.createDataFrame([("x", t) for t in (5, 15, 20, 25)], "symbol string, recv_ns long")
    cs = spark.createDataFrame([("x", 1), ("x", 20)], "symbol string, recv_ns long")
    assert [r["session_id"] for r in gaps.sessions(es, cs).orderBy("recv_ns").collect()] == [1, 1, 2, 2]


def test_throttle_and_outages(spark):
    df = spark.createDataFrame([("x", t) for t in (0, 3, 5, 9, 10, 11, 30)], "symbol string, at_ms long")
    assert sorted(r["at_ms"] for r in gaps.throttled(df, ["symbol"], "at_ms", 5).collect()) == [0, 5, 10, 30]
    marks = spark.createDataFrame([("e", 1, "connect"), ("e", 5, "disconnect"), ("e", 7, "disconnect"), ("e", 9, "connect"), ("e", 12, "disconnect")], "endpoint string, t long, state string")
    assert sorted((r["start_ns"], r["end_ns"]) for r in gaps.outages(marks, ["endpoint"], "t", "state").where("end_ns is not null").collect()) == [(5, 9)]


def test_rank_percentiles_do_not_interpolate(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(10)], "k string, v double")
    assert tuple(quality.by_rank(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}).first()) == ("x", 5.0, 9.0)


def test_linear_model_learns(spark):
    rng = random.Random(0)
    rows = [(f, "train" if i < 300 else "test", i, (x := rng.gauss(0, 1)), rng.gauss(5, 2), 2 if x > 0.5 else 0 if x < -0.5 else 1) for f in range(2) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, role string, frame_id long, a double, b double, y int")
    got = ml.fit_predict(df, ["a", "b"], max_iter=50)
    assert got.count() == 200 and got.where("y = p").count() > 180
