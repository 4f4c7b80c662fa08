"""Continuity of update ids, gap records, throttles, outages and the loss report."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators import frames


def sessions(events: DataFrame, connects: DataFrame) -> DataFrame:
    """Adds ``session_id``: connect snapshots (symbol, recv_ns) received up to each event.

    Both sides are united and counted in one window, so no range join is needed.
    """
    marks = connects.select("symbol", F.col("recv_ns"), F.lit(1).alias("_mark"))
    rows = events.withColumn("_mark", F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("symbol").orderBy("recv_ns", F.col("_mark").desc())
    return both.withColumn("session_id", F.sum("_mark").over(order).cast("long")).where("_mark = 0").drop("_mark")


def sequence_gaps(events: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Rows whose ``prev_id`` is not the final id of the row before: expected, got, delta and kind.

    The comparison always moves on with the latest row, unlike the replay, which stays at the last applied one.
    """
    rows = frames.with_previous(events, {"expected_prev": F.col("final_id")}, keys, order).where(F.col("expected_prev").isNotNull() & (F.col("prev_id") != F.col("expected_prev")))
    delta = F.col("prev_id") - F.col("expected_prev")
    return rows.withColumn("delta", delta).withColumn("kind", F.when(delta > 0, "missing").otherwise("duplicate_or_reorder"))


def gap_report(gaps: DataFrame, depth_count: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps by key: count, kinds, ids lost, upper median and largest delta, loss rate against events (``n_depth``)."""
    size = F.abs("delta")
    # counted by size first, so the window goes over distinct sizes
    counted = gaps.groupBy(*keys, size.alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("kind") == "missing").alias("m"))
    ranked = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("size"))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    report = ranked.groupBy(*keys).agg(
        F.sum("c").alias("gaps"),
        F.sum("m").alias("missing"),
        F.sum(F.col("size") * F.col("c")).alias("ids_lost"),
        F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("size"))).alias("median_delta"),
        F.max("size").alias("max_delta"),
    )
    joined = depth_count.join(report, keys, "left").na.fill(0, ["gaps", "missing", "ids_lost"])
    return joined.withColumn("loss_rate", F.try_divide(F.col("ids_lost"), F.col("n_depth") + F.col("ids_lost")))


def gap_status(gaps_per_hour: Column) -> Column:
    """OK under 5 gaps an hour, WARN under 40, else BAD."""
    return F.when(gaps_per_hour < 5, "OK").when(gaps_per_hour < 40, "WARN").otherwise("BAD")


#: Cooldowns that a bucket of the limiter spans.
COOLDOWNS = 256


def throttled(rows: DataFrame, keys: list[str], time: str, cooldown: int) -> DataFrame:
    """Rows that a limiter lets through: the first, then each that comes ``cooldown`` or more after the last kept one.

    What is kept depends on what was kept, but a bucket of times depends on the ones before only through the last time kept there, and that only
    through the first time it lets through, which lies in the bucket's first cooldown.  So each bucket gives its last kept time as a step function of the
    first; a scan over the buckets composes these; then every bucket is walked from its true entry.  No key is one task's.  Rows
    at one time share its fate; rows without a time don't pass.
    """
    timed = rows.where(F.col(time).isNotNull())
    if cooldown <= 0:
        return timed
    key, width = F.to_json(F.struct(*keys)), COOLDOWNS * cooldown
    times = timed.select(key.alias("_key"), F.col(time).cast("long").alias("t")).distinct().withColumn("_bucket", F.floor(F.col("t") / F.lit(width)))
    functions = times.groupBy("_key", "_bucket").applyInPandas(lambda pdf: last_kept(pdf, cooldown, width), "_key string, _bucket long, upto array<long>, last array<long>")

    def scan(batches):
        at, last = None, None
        for pdf in batches:
            entries = []
            for k, upto, exits in zip(pdf["_key"], pdf["upto"], pdf["last"], strict=True):
                if k != at:
                    at, last = k, None
                entries.append(last)
                place = 0 if last is None else bisect.bisect_left(list(upto), last + cooldown)
                if place < len(upto):
                    last = int(exits[place])
            yield pd.DataFrame({"_key": pdf["_key"], "_bucket": pdf["_bucket"], "entry": pd.array(entries, "Int64")})

    entered = functions.repartition("_key").sortWithinPartitions("_key", "_bucket").mapInPandas(scan, "_key string, _bucket long, entry long")
    kept = times.groupBy("_key", "_bucket").cogroup(entered.groupBy("_key", "_bucket")).applyInPandas(lambda own, entry: walked(own, entry, cooldown), "_key string, t long")
    return timed.withColumn("_key", key).withColumn("t_", F.col(time).cast("long")).join(kept.withColumnRenamed("t", "t_"), ["_key", "t_"], "left_semi").select(*rows.columns)


def last_kept(pdf: pd.DataFrame, cooldown: int, width: int) -> pd.DataFrame:
    """A bucket's last kept time by the first one: for a first time up to ``upto[i]``, ``last[i]``."""
    t = np.sort(pdf["t"].to_numpy())
    after = np.searchsorted(t, t + cooldown)
    last = t.copy()
    for i in range(len(t) - 1, -1, -1):
        if after[i] < len(t):
            last[i] = last[after[i]]
    begin = int(pdf["_bucket"].iloc[0]) * width
    n = min(len(t), int(np.searchsorted(t, begin + cooldown)) + 1)  # no first time lies further on
    ends = np.flatnonzero(np.append(last[1:n] != last[: n - 1], True))
    return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "_bucket": [pdf["_bucket"].iloc[0]], "upto": [t[ends].tolist()], "last": [last[ends].tolist()]})


def walked(own: pd.DataFrame, entry: pd.DataFrame, cooldown: int) -> pd.DataFrame:
    """The kept times of a bucket."""
    t, last = np.sort(own["t"].to_numpy()), entry["entry"].iloc[0]
    i = 0 if pd.isna(last) else int(np.searchsorted(t, int(last) + cooldown))
    kept = []
    while i < len(t):
        kept.append(int(t[i]))
        i = int(np.searchsorted(t, t[i] + cooldown))
    return pd.DataFrame({"_key": own["_key"].iloc[0] if len(own) else "", "t": pd.array(kept, "int64")})


def outages(marks: DataFrame, keys: list[str], time: str, state: str) -> DataFrame:
    """Intervals from a disconnect to the next connect: start, end (null while open), duration in seconds; of marks at one time the connects come first."""
    w = Window.partitionBy(*keys).orderBy(time, F.when(F.col(state) == "connect", 0).otherwise(1))
    ends = F.min(F.when(F.col(state) == "connect", F.col(time))).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = marks.withColumn("_before", F.lag(state).over(w)).withColumn("end_ns", ends)
    opened = rows.where((F.col(state) == "disconnect") & F.coalesce(F.col("_before") != "disconnect", F.lit(True)))
    return opened.select(*keys, F.col(time).alias("start_ns"), "end_ns", ((F.col("end_ns") - F.col(time)) / 1e9).alias("duration_s"))


def missing_streams(expected: DataFrame, seen: DataFrame, endpoints_up: DataFrame) -> DataFrame:
    """Expected (endpoint, stream) never seen, and why: its endpoint never connected, or it is silent."""
    silent = expected.join(seen.select("stream").distinct(), "stream", "left_anti")
    up = endpoints_up.select("endpoint").distinct().withColumn("_up", F.lit(True))
    return silent.join(F.broadcast(up), "endpoint", "left").withColumn("cause", F.when(F.col("_up"), "silent").otherwise("never_connected")).drop("_up")
