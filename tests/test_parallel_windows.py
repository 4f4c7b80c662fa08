"""Bucketed forms against plain ones: places, halos, blocks, bootstrap by joins, windows of frames, Adam."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.operators import adam, book, cost, frames, gaps, tensors


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(frames, "BUCKET", 16)


def series(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows, seq = [], 0
    for i in range(n):
        seq += rng.choice([1, 1, 2, 40])
        rows.append(("hot" if i % 10 else "cold", seq, rng.gauss(0.3, 1.0)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, seq long, edge double")


def test_places_and_blocks_equal_whole_windows(spark, small_buckets):
    df = series(spark)
    w = Window.partitionBy("symbol").orderBy("seq")
    want = {(r["symbol"], r["seq"]): (r["pos"], r["s"]) for r in df.withColumn("pos", F.row_number().over(w) - 1).withColumn("s", F.when(F.count("*").over(w.rowsBetween(0, 24)) == 25, F.sum("edge").over(w.rowsBetween(0, 24)))).collect()}
    got = {(r["symbol"], r["seq"]): r["pos"] for r in frames.numbered(df, ["symbol"]).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    sums = {(r["symbol"], r["seq"]): r["block_sum"] for r in cost.block_sums(df, 25, ["symbol"]).collect()}
    assert sums.keys() == want.keys() and all((sums[k] is None) == (v[1] is None) and (v[1] is None or abs(sums[k] - v[1]) < 1e-9) for k, v in want.items())


@pytest.mark.parametrize(("before", "after"), [(0, 0), (3, 0), (0, 20), (40, 5)])
def test_halos_hold_what_windows_reach(spark, before, after):
    df = spark.range(100).select(F.col("id").alias("pos"))
    got = frames.haloed(df, "pos", before, after, 16)
    by: dict[int, set] = {}
    for r in got.collect():
        by.setdefault(r["_bucket"], set()).add((r["pos"], r["_halo"]))
    for b in range(7):
        own = range(16 * b, min(16 * b + 16, 100))
        want = {(p, p not in own) for p in range(max(0, own[0] - before), min(100, own[-1] + after + 1))}
        assert want <= by[b] and {p for p, halo in by[b] if not halo} == set(own)


def test_bootstrap_equals_resamples_with_the_same_starts(spark, small_buckets):
    df = series(spark, 230, 3).unionByName(spark.createDataFrame([("one", 1, 2.0), ("none", 1, None)], "symbol string, seq long, edge double"))
    rng, draws, want = np.random.default_rng(4), [], {}
    for symbol in ("hot", "cold"):
        x = np.array([r["edge"] for r in df.where(F.col("symbol") == symbol).orderBy("seq").collect()])
        n, length = len(x), 11
        whole, rest = divmod(n, length)
        means = []
        for r in range(60):
            total = 0.0
            for b in range(whole + bool(rest)):
                size = length if b < whole else rest
                start = int(rng.integers(0, n - size + 1))
                draws.append((symbol, r, b, start))
                total += x[start : start + size].sum()
            means.append(total / n)
        want[symbol] = (n, x.mean(), *np.percentile(means, [2.5, 97.5]))
    given = spark.createDataFrame(draws, "symbol string, resample int, block long, start long")
    got = {r["symbol"]: tuple(r)[1:] for r in cost.bootstrap(df, ["symbol"], 11, draws=given).collect()}
    for symbol, values in want.items():
        assert got[symbol] == pytest.approx(values, abs=1e-9)
    assert got["one"] == (1, 2.0, None, None) and "none" not in got
    # drawn by the generator, the interval is about as wide as numpy's
    drawn = {r["symbol"]: r for r in cost.bootstrap(df, ["symbol"], 11, 400).collect()}
    x = np.array([r["edge"] for r in df.where("symbol = 'hot'").orderBy("seq").collect()])
    lo, hi = cost.bootstrap_mean(x, 11, 400)
    assert drawn["hot"]["lo"] == pytest.approx(lo, abs=0.06) and drawn["hot"]["hi"] == pytest.approx(hi, abs=0.06)


def test_windows_are_whole_across_buckets_and_never_cross_a_segment(spark):
    rng = np.random.default_rng(2)
    rows = [("x", s, 100 * s + i, i, float(100 + rng.random()), [float(v) for v in rng.random(4) + 1]) for s, n in ((0, 90), (1, 5), (2, 33)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, segment_id long, seq long, pos long, mid double, frame array<double>")
    seen = tensors.map_windows(df, F.col("pos") >= 6, 7, lambda x: {"total": x.sum((1, 2)), "first": x[:, 0, 0]}, "total double, first double", (0.5, 2.0), bucket=10)
    want = {}
    for s in (0, 1, 2):
        mine = [r for r in rows if r[1] == s]
        for e in range(6, len(mine)):
            x = np.array([r[5] for r in mine[e - 6 : e + 1]])
            mid = mine[e][4]
            x[:, 0::2] = (x[:, 0::2] - mid) / mid * 1e4
            x[:, 1::2] = (np.log1p(x[:, 1::2]) - 0.5) / 2.0
            want[s, mine[e][2]] = (x.sum(), x[0, 0])
    got = {(r["segment_id"], r["seq"]): (r["total"], r["first"]) for r in seen.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_adam_equals_numpy_step_by_step(spark):
    rng = np.random.default_rng(0)
    n = 240
    x = rng.normal(size=(n, 2))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=n) > 0.6, 2, np.where(x[:, 1] > 0.4, 0, 1))
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "seq long, a double, b double, y int")
    settings = adam.Settings(epochs=3, batches=3, rate=0.1, decay=0.01, seed=7)
    got, history = adam.train(df.repartition(5), df, ["a", "b"], settings)
    batches = {e: {r["seq"]: r["b"] for r in df.select("seq", adam.in_batch("seq", e, settings).alias("b")).collect()} for e in (1, 2, 3)}
    counts = np.bincount(y, minlength=3)
    weights = n / (3 * counts)
    theta = np.zeros((3, 3))
    m, v, t, scores, kept = np.zeros_like(theta), np.zeros_like(theta), 0, [], []
    for epoch in (1, 2, 3):
        for b in range(3):
            rows = [i for i in range(n) if batches[epoch][i] == b]
            g = np.zeros_like(theta)
            for i in rows:
                z = theta[:, :2] @ x[i] + theta[:, 2]
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                g += weights[y[i]] * np.outer(p, [*x[i], 1.0])
            g /= weights[y[rows]].sum()
            g = g * min(1.0, 1.0 / (np.sqrt((g**2).sum()) + 1e-6)) + 0.01 * theta
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        guess = (x @ theta[:, :2].T + theta[:, 2]).argmax(1)
        f1 = [2 * ((guess == c) & (y == c)).sum() / max(1, (guess == c).sum() + (y == c).sum()) for c in range(3)]
        scores.append(float(np.mean(f1)))
        kept.append(theta.copy())
    rows = history.orderBy("epoch").collect()
    assert [r["macro_f1"] for r in rows] == pytest.approx(scores) and [r["epoch"] for r in rows] == [1, 2, 3]
    assert got == pytest.approx(kept[int(np.argmax(scores))], abs=1e-9)


def test_training_stops_after_its_patience(spark):
    df = spark.createDataFrame([(i, 0.0, i % 3) for i in range(30)], "seq long, a double, y int")
    _, history = adam.train(df, df, ["a"], adam.Settings(epochs=9, batches=1, patience=2, rate=1e-9))
    rows = history.orderBy("epoch").collect()
    assert len(rows) == 3 and rows[-1]["stopped"] and rows[-1]["best_epoch"] == 1
    empty, _ = adam.train(df.limit(0), df, ["a"], adam.Settings(epochs=1, batches=1))
    assert (empty == 0).all()


def limited(times, cooldown):
    kept, last = [], None
    for t in sorted(times):
        if last is None or t - last >= cooldown:
            last = t
        if t == last:
            kept.append(t)
    return kept


@pytest.mark.parametrize(("cooldown", "spread"), [(5, 40), (7, 3_000), (100, 900), (1, 50), (0, 30)])
def test_the_limiter_equals_a_walk(spark, monkeypatch, cooldown, spread):
    monkeypatch.setattr(gaps, "COOLDOWNS", 3)
    rng = random.Random(cooldown)
    rows = [(k, rng.randint(-spread, spread), i) for k, n in (("hot", 400), ("cold", 15), (None, 30), ("", 4)) for i in range(n)] + [("hot", None, 1)]
    df = spark.createDataFrame(rows, "symbol string, at_ms long, n int").repartition(5)
    got = [(r["symbol"], r["at_ms"]) for r in gaps.throttled(df, ["symbol"], "at_ms", cooldown).collect()]
    want = [(k, t) for k in ("hot", "cold", None, "") for t in limited([r[1] for r in rows if r[0] == k and r[1] is not None], cooldown)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert gaps.throttled(df.limit(0), ["symbol"], "at_ms", cooldown).count() == 0


def test_marks_at_one_time_do_not_multiply(spark):
    marks = [("a", 10, "disconnect"), ("a", 10, "connect"), ("a", 20, "disconnect"), ("a", 20, "disconnect"), ("a", 50, "connect")]
    out = gaps.outages(spark.createDataFrame(marks, "endpoint string, at long, state string"), ["endpoint"], "at", "state").collect()
    assert [(r["start_ns"], r["end_ns"]) for r in out] == [(10, 50)]


def test_a_book_by_price_equals_a_walk(spark, small_buckets):
    rng, rows = random.Random(6), []
    for i in range(200):
        final = 40 + i * 2 - rng.choice([0, 0, 0, 9])
        rows.append(("x", 3 * i, final, [[f"{rng.randint(90, 99)}.5", str(rng.choice([0, 1, 2]))] for _ in range(2)], [[f"{rng.randint(100, 109)}.0", str(rng.choice([0, 1]))]]))
    rng.shuffle(rows)
    snap = ("x", 60, [["95.50", "7"]], [["104", "3"]])
    levels = "array<array<string>>"
    events = spark.createDataFrame(rows, f"symbol string, seq long, final_id long, bids {levels}, asks {levels}")
    snaps = spark.createDataFrame([snap], f"symbol string, update_id long, bids {levels}, asks {levels}")
    for steps in (3, 50, None):
        bids, asks, last, n = {95.5: 7.0}, {104.0: 3.0}, 60, 0
        for _, _, final, b, a in sorted(rows, key=lambda r: r[1]):
            if final <= last or n == steps:
                continue
            for side, changes in ((bids, b), (asks, a)):
                for p, q in changes:
                    side[float(p)] = float(q)
            last, n = final, n + 1
        bids, asks = ({p: q for p, q in side.items() if q} for side in (bids, asks))
        r = book.price_walk(events, snaps, steps).first()
        assert (r["steps"], r["n_bids"], r["n_asks"], r["best_bid"], r["best_ask"]) == (n, len(bids), len(asks), max(bids, default=None), min(asks, default=None))
