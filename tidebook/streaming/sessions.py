"""Keyed processors with timers: continuity, outages, subscriptions, snapshot requests.

Each keeps its state in the state store and its clock in timers, so a restart goes on where the checkpoint stands.  ``clock`` is ``EventTime`` (the
rows' own times, with the caller's watermark) or ``ProcessingTime`` (the clock on the wall, for live feeds).
Continuity and outages need no timer.  Their keys may be many with few rows each, and one visit of the state takes longer than a key's rows, so keys are
dealt over ``GROUPS`` groups that share one visit.
Rows of one micro-batch are put in order inside a key; what an admission limit lets into a batch bounds that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

GAPS = "symbol string, seq long, expected_prev long, got_prev long, delta long, kind string"
OUTAGES = "endpoint string, state string, start_ns long, end_ns long, duration_s double"
MISSING = "endpoint string, stream string, cause string"
REQUESTS = "symbol string, at_ms long, reason string, throttled long"

#: Groups that symbols or endpoints are dealt over: several for each core, and fixed for the life of a checkpoint.
GROUPS = 512


def prepare(spark: SparkSession) -> None:
    """Processors with timers need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def remembered(state: GroupState) -> dict:
    """What a group's state says of each of its keys."""
    return dict(zip(*state.get, strict=True)) if state.exists else {}


def in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


def continuity(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Gap records of a group of symbols: rows whose ``prev_id`` isn't the final id of the symbol's row before; rows that are not ``checked`` have none to compare."""
    last, out = remembered(state), []
    for symbol, seq, got, final, checked, known in in_order(batches, "seq")[["symbol", "seq", "prev_id", "final_id", "checked", "known"]].itertuples(index=False, name=None):
        expected = last.get(symbol)
        if checked and expected is not None and got != expected:
            out.append((symbol, seq, expected, got, got - expected, "missing" if got > expected else "duplicate_or_reorder"))
        if known:
            last[symbol] = final
        else:
            last.pop(symbol, None)
    state.update((list(last), list(last.values())))
    yield frame(out, ["symbol", "seq", "expected_prev", "got_prev", "delta", "kind"], ["seq", "expected_prev", "got_prev", "delta"])


def ups_and_downs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An ``open`` row when an endpoint of the group goes down and a ``closed`` one when it is back; a second disconnect changes nothing."""
    down, out = remembered(state), []
    for endpoint, at, what in in_order(batches, "at_ns")[["endpoint", "at_ns", "state"]].itertuples(index=False, name=None):
        if what == "disconnect" and endpoint not in down:
            down[endpoint] = at
            out.append((endpoint, "open", at, None, None))
        elif what == "connect" and endpoint in down:
            since = down.pop(endpoint)
            out.append((endpoint, "closed", since, at, (at - since) / 1e9))
    state.update((list(down), list(down.values())))
    yield frame(out, ["endpoint", "state", "start_ns", "end_ns", "duration_s"], ["start_ns", "end_ns"])


class Subscriptions(StatefulProcessor):
    """Expected streams of an endpoint that delivered nothing by the deadline, and why.

    Rows: kind ``expect`` (a stream that should come), ``connect`` (the endpoint is up), ``message``.  The deadline starts with the first
    row; what comes after it is too late.
    """

    def __init__(self, deadline_ms: int, clock: str = "EventTime"):
        self.deadline_ms, self.clock = deadline_ms, clock

    def init(self, handle) -> None:
        self.handle = handle
        self.expected = handle.getMapState("expected", "stream string", "n long")
        self.seen = handle.getMapState("seen", "stream string", "n long")
        self.state = handle.getValueState("state", "until long, connected boolean, done boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        found = in_order(rows, "at_ms")
        if self.state.exists():
            until, connected, done = self.state.get()
        else:
            begin = int(found["at_ms"].iloc[0]) if self.clock == "EventTime" else timerValues.getCurrentProcessingTimeInMs()
            until, connected, done = begin + self.deadline_ms, False, False
            self.handle.registerTimer(until)
        if done:
            return
        now = found["at_ms"] if self.clock == "EventTime" else pd.Series(timerValues.getCurrentProcessingTimeInMs(), index=found.index)
        found = found[now <= until]
        for stream in found.loc[found["kind"] == "expect", "stream"].unique():
            self.expected.updateValue((stream,), (1,))
        for stream, n in found.loc[found["kind"] == "message", "stream"].value_counts().items():
            had = self.seen.getValue((stream,))[0] if self.seen.exists() and self.seen.containsKey((stream,)) else 0
            self.seen.updateValue((stream,), (had + int(n),))
        self.state.update((until, bool(connected or (found["kind"] != "expect").any()), False))
        yield frame([], ["endpoint", "stream", "cause"], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        until, connected, _ = self.state.get()
        seen = {k[0] for k in self.seen.keys()} if self.seen.exists() else set()  # noqa: SIM118
        missing = sorted({k[0] for k in self.expected.keys()} - seen) if self.expected.exists() else []  # noqa: SIM118
        self.state.update((until, connected, True))
        self.expected.clear()
        self.seen.clear()
        cause = "silent" if connected else "never_connected"
        yield frame([(key[0], stream, cause) for stream in missing], ["endpoint", "stream", "cause"], [])

    def close(self) -> None:
        pass


class SnapshotRequests(StatefulProcessor):
    """When a symbol's snapshots are due: at its first row (``connect``), each ``period_ms`` after it (``periodic``), and at gaps.

    Gaps share a cooldown: one that comes within ``cooldown_ms`` of the last request for a gap is counted, and the next request tells how
    many (``throttled``).
    """

    def __init__(self, period_ms: int = 1_800_000, cooldown_ms: int = 5_000):
        self.period_ms, self.cooldown_ms = period_ms, cooldown_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next_ms long, gap_ms long, throttled long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        found, out = in_order(rows, "at_ms"), []
        if self.state.exists():
            due, gap, throttled = self.state.get()
        else:
            begin = int(found["at_ms"].iloc[0])
            due, gap, throttled = begin + self.period_ms, None, 0
            self.handle.registerTimer(due)
            out.append((key[0], begin, "connect", 0))
        for at in found.loc[found["kind"] == "gap", "at_ms"]:
            if gap is None or at - gap >= self.cooldown_ms:
                out.append((key[0], int(at), "gap", throttled))
                gap, throttled = int(at), 0
            else:
                throttled += 1
        self.state.update((due, gap, throttled))
        yield frame(out, ["symbol", "at_ms", "reason", "throttled"], ["at_ms", "throttled"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        due, gap, throttled = self.state.get()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        while due <= now:
            out.append((key[0], due, "periodic", 0))
            due += self.period_ms
        self.handle.registerTimer(due)
        self.state.update((due, gap, throttled))
        yield frame(out, ["symbol", "at_ms", "reason", "throttled"], ["at_ms", "throttled"])

    def close(self) -> None:
        pass


def frame(rows: list[tuple], names: list[str], longs: list[str]) -> pd.DataFrame:
    """Rows as a frame of plain objects and nullable whole numbers."""
    return pd.DataFrame(rows, columns=names, dtype=object).astype(dict.fromkeys(longs, "Int64"))


def dealt(rows: DataFrame, key: str, run: Callable, schema: str, groups: int) -> DataFrame:
    """``run`` over groups that the keys are dealt to; a group's state is the list of its keys beside that of their values."""
    group = F.pmod(F.hash(key), F.lit(groups)).alias("_group")
    return rows.select(group, *rows.columns).groupBy("_group").applyInPandasWithState(run, schema, "keys array<string>, values array<long>", "append", GroupStateTimeout.NoTimeout)


def gaps(rows: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``GAPS`` of a stream symbol, seq, kind, prev_id, final_id; a ``connect`` row starts its symbol afresh, and so does one without a final id."""
    event = ~F.col("kind").eqNullSafe("connect")
    # whole numbers would lose digits where nulls turn a column into doubles
    ids = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("prev_id", "final_id")]
    marked = rows.select("symbol", "seq", *ids, (event & F.col("prev_id").isNotNull()).alias("checked"), (event & F.col("final_id").isNotNull()).alias("known"))
    return dealt(marked, "symbol", continuity, GAPS, groups)


def outages(marks: DataFrame, groups: int = GROUPS) -> DataFrame:
    """``OUTAGES`` of a stream endpoint, at_ns, state (connect, disconnect)."""
    return dealt(marks.select("endpoint", "at_ns", "state"), "endpoint", ups_and_downs, OUTAGES, groups)


def missing_streams(rows: DataFrame, deadline_ms: int = 30_000, clock: str = "EventTime") -> DataFrame:
    """``MISSING`` of a stream endpoint, stream, kind, at_ms (for event time also the watermarked column)."""
    return rows.groupBy("endpoint").transformWithStateInPandas(Subscriptions(deadline_ms, clock), MISSING, "Append", clock)


def snapshot_requests(rows: DataFrame, period_ms: int = 1_800_000, cooldown_ms: int = 5_000) -> DataFrame:
    """``REQUESTS`` of a stream symbol, kind (message, gap), at_ms and a watermarked column."""
    return rows.groupBy("symbol").transformWithStateInPandas(SnapshotRequests(period_ms, cooldown_ms), REQUESTS, "Append", "EventTime")
