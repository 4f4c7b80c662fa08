"""The parallel automaton against the machine that takes events one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import book, trust

EVENT = "symbol string, seq long, first_id long, final_id long, prev_id long, withheld boolean"
SNAP = "symbol string, update_id long, seq long"


def plainly(events, snapshots, trusted=True):
    """Labels of one symbol by ``Automaton``."""
    machine, out = book.Automaton(trusted), {}
    rows = sorted([(seq, 0, update_id, 0, 0) for _, update_id, seq in snapshots] + [(seq, 2 if held else 1, first, final, prev) for _, seq, first, final, prev, held in events])
    for seq, kind, first, final, prev in rows:
        if kind == 0:
            machine.add_snapshots([first])
            continue
        outcome, anchor, expected = "withheld", None, None
        if kind == 2:
            machine.withhold(final, prev)
        else:
            outcome, anchor, expected = machine.step(first, final, prev)
        live = outcome != "unanchored" and machine.segment >= 0
        out[seq] = (outcome, machine.segment if live else None, machine.chain if live else None, anchor, expected)
    return out


def stream(rng, symbol, n, faults, snapshots):
    """A feed with losses, repeats, late events, rewinds and withheld stretches, and snapshots that come early, late and twice."""
    events, known, at, seq = [], [], 100, 0
    history = []
    while len(events) < n:
        width = rng.randint(1, 6)
        first, final, prev = at + 1, at + width, at
        at = final
        history.append((first, final, prev))
        if rng.random() < snapshots:
            update = rng.choice([prev, prev, first, final - 1, rng.choice(history)[2], rng.choice(history)[1]])
            for _ in range(rng.choice([1, 1, 2])):
                known.append((symbol, update, max(0, seq - rng.randint(-6, 6))))
        fault = rng.random()
        if fault < faults:  # lost, sometimes a stretch
            at += rng.choice([0, 0, 7])
            continue
        if fault < 2 * faults and len(history) > 9:  # a rewind: old events once more
            back = rng.randint(1, 8)
            for old in history[-back:]:
                events.append((symbol, seq, *old, False))
                seq += 1
            continue
        held = fault < 3 * faults
        events.append((symbol, seq, first, final, prev, held))
        seq += rng.choice([1, 1, 1, 5])
        if fault > 1 - faults and len(events) > 3:  # a late one
            events.append((symbol, seq, *rng.choice(history), False))
            seq += 1
        if rng.random() < faults / 20:  # ids begin anew
            at = rng.randint(50, 200)
    return events, known




@pytest.mark.parametrize(("faults", "snapshots"), [(0.0, 0.05), (0.05, 0.1), (0.25, 0.3), (0.4, 0.02)])
@pytest.mark.parametrize("trusted", [True, False])
def test_equals_the_sequential_machine(spark, faults, snapshots, trusted):
    rng = random.Random(str((faults, snapshots)))
    events, known, want = [], [], {}
    for i in range(40):
        e, s = stream(rng, f"s{i}", rng.choice([1, 5, 60, 200]), faults, snapshots)
        events += e
        known += s
        want |= {(f"s{i}", seq): label for seq, label in plainly(e, s, trusted).items()}
    rng.shuffle(events)
    df = spark.createDataFrame(events, EVENT)
    for bucket in (7, 64, 1 << 20):
        got = {(r["symbol"], r["seq"]): tuple(r)[2:] for r in trust.label(df, spark.createDataFrame(known or [("none", 1, 1)], SNAP), trusted, bucket).collect()}
        assert got == want, bucket
    if trusted:
        found = {label[0] for label in want.values()}
        assert "applied" in found and (not faults or {"desync", "skipped", "unanchored"} <= found)


def sizes_of(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_a_hot_symbol_is_many_tasks(spark):
    rng = random.Random(4)
    events, known = stream(rng, "hot", 12_000, 0.03, 0.05)
    few, more = stream(rng, "cold", 100, 0.03, 0.05)
    df, snaps = spark.createDataFrame(events + few, EVENT), spark.createDataFrame(known + more, SNAP)
    labels = trust.label(df, snaps, bucket=256)
    got = {(r["symbol"], r["seq"]): tuple(r)[2:] for r in labels.collect()}
    assert got == {("hot", seq): x for seq, x in plainly(events, known).items()} | {("cold", seq): x for seq, x in plainly(few, more).items()}
    # no task of the labelling holds the symbol
    rows = spark.read.schema(trust.ROWS).parquet(labels.inputFiles()[0].rsplit("/", 1)[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together
    try:
        sizes = sizes_of(trust.by_bucket(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.7 * sum(sizes) and len(sizes) >= 3


def test_empty_streams_and_null_symbols(spark):
    none = spark.createDataFrame([], EVENT)
    assert trust.label(none, spark.createDataFrame([], SNAP)).count() == 0
    rows = [(None, 1, 11, 12, 10, False), (None, 2, 13, 14, 12, False), ("x", 1, 11, 12, 10, False)]
    got = {(r["symbol"], r["seq"]): r["outcome"] for r in trust.label(spark.createDataFrame(rows, EVENT), spark.createDataFrame([("x", 10, 0)], SNAP)).collect()}
    assert got == {(None, 1): "unanchored", (None, 2): "unanchored", ("x", 1): "applied"}


def test_wide_events_and_early_ids(spark):
    rows = [("x", 0, 0, 5, -1, False), ("x", 1, 6, 10**15, 5, False), ("x", 2, 1, 3 * 10**17, 0, False), ("x", 3, 9, 2, 1, False)]
    snaps = [("x", -1, 0), ("x", 10**14, 0), ("x", 2 * 10**17, 2)]
    got = {r["seq"]: tuple(r)[2:] for r in trust.label(spark.createDataFrame(rows, EVENT), spark.createDataFrame(snaps, SNAP)).collect()}
    assert got == plainly(rows, snaps)
