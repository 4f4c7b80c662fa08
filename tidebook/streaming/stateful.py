"""Streaming forms: book replay, gap detection, watchdog, snapshot throttle, minute metrics, hourly sink.

Keyed state is held by Spark's state store, so a lost executor resumes from the checkpoint.  There is no watermark on
purpose: late, repeated and reordered events are recorded or skipped by their ids, never dropped by time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebook.operators.book import Automaton, Book

LEVELS = "array<array<string>>"
UNION = f"symbol string, seq long, kind string, event_ms long, first_id long, final_id long, prev_id long, bids {LEVELS}, asks {LEVELS}"
LEVEL = "array<struct<p:double,q:double>>"
OUT = f"symbol string, seq long, outcome string, segment_id long, event_ms long, update_id long, bids {LEVEL}, asks {LEVEL}"


def union_stream(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events and snapshots as one stream of tagged rows."""
    e = events.select("symbol", "seq", F.lit("event").alias("kind"), "event_ms", "first_id", "final_id", "prev_id", "bids", "asks")
    s = snapshots.select("symbol", (F.col("seq") if "seq" in snapshots.columns else F.lit(-1)).cast("long").alias("seq"), F.lit("snapshot").alias("kind"), F.lit(None).cast("long").alias("event_ms"), F.col("update_id").alias("first_id"), F.lit(None).cast("long").alias("final_id"), F.lit(None).cast("long").alias("prev_id"), "bids", "asks")
    return e.unionByName(s)


def replay(rows: DataFrame, tick: float, shown: int = 10, keep: int = 500, trust: bool = True) -> DataFrame:
    """Book states and breaks of a stream of ``UNION`` rows; within a batch a symbol's rows are put in order of seq.

    The state of a symbol is its book, cursor, segment and unused snapshots.  ``keep`` bounds the book.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, book, pool = Automaton(trust), Book(tick, keep), {}
        if state.exists:
            saved = json.loads(state.get[0])
            machine.last, machine.fresh, machine.segment, machine.pool = saved["last"], saved["fresh"], saved["segment"], saved["pool"]
            book.bids = {int(k): v for k, v in saved["bids"].items()}
            book.asks = {int(k): v for k, v in saved["asks"].items()}
            pool = {int(k): v for k, v in saved["books"].items()}
        rows = pd.concat(list(batches)).sort_values(["seq", "kind"], ascending=[True, False])
        out = []
        for r in rows.itertuples(index=False):
            lists = lambda x: [] if x is None else [list(level) for level in x]
            if r.kind == "snapshot":
                machine.add_snapshots([int(r.first_id)])
                pool[int(r.first_id)] = [lists(r.bids), lists(r.asks)]
                continue
            outcome, anchor, _ = machine.step(int(r.first_id), int(r.final_id), int(r.prev_id))
            if anchor is not None:
                book.load(*pool[anchor])
                pool = {k: v for k, v in pool.items() if k > anchor}
            if outcome in ("applied", "desync"):
                if outcome == "applied":
                    book.apply(lists(r.bids), lists(r.asks))
                bids, asks = book.top(shown) if outcome == "applied" else ([], [])
                out.append((key[0], int(r.seq), outcome, machine.segment, int(r.event_ms), int(r.final_id), bids, asks))
        state.update((json.dumps({"last": machine.last, "fresh": machine.fresh, "segment": machine.segment, "pool": machine.pool, "bids": book.bids, "asks": book.asks, "books": pool}),))
        yield pd.DataFrame(out, columns=["symbol", "seq", "outcome", "segment_id", "event_ms", "update_id", "bids", "asks"])

    return rows.groupBy("symbol").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def gaps(events: DataFrame) -> DataFrame:
    """Sequence gaps of a stream (symbol, session_id, seq, prev_id, final_id); a new session starts afresh."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if last is not None and r.prev_id != last:
                delta = int(r.prev_id - last)
                out.append((*key, int(r.seq), int(last), int(r.prev_id), delta, "missing" if delta > 0 else "duplicate_or_reorder"))
            last = int(r.final_id)
        state.update((last,))
        yield pd.DataFrame(out, columns=["symbol", "session_id", "seq", "expected_prev", "got_prev", "delta", "kind"])

    return events.groupBy("symbol", "session_id").applyInPandasWithState(run, "symbol string, session_id long, seq long, expected_prev long, got_prev long, delta long, kind string", "last long", "append", GroupStateTimeout.NoTimeout)


def throttle(requests: DataFrame, cooldown_ms: int) -> DataFrame:
    """Requests (symbol, at_ms) that a limiter lets through, by their own times."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted(pd.concat(list(batches)).at_ms):
            if last is None or at - last >= cooldown_ms:
                out.append((key[0], int(at)))
                last = int(at)
        state.update((last,))
        yield pd.DataFrame(out, columns=["symbol", "at_ms"])

    return requests.groupBy("symbol").applyInPandasWithState(run, "symbol string, at_ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def watchdog(messages: DataFrame, idle_ms: int) -> DataFrame:
    """A row (endpoint, n, stale) for each endpoint's batch, and one with stale = true when it falls silent for ``idle_ms``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame([(key[0], n, True)], columns=["endpoint", "n", "stale"])
            return
        n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
        state.update((n,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], n, False)], columns=["endpoint", "n", "stale"])

    return messages.groupBy("endpoint").applyInPandasWithState(run, "endpoint string, n long, stale boolean", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def minute_metrics(rows: DataFrame, time: str = "ts", delay: str = "2 minutes") -> DataFrame:
    """Messages, distinct streams and bytes of each minute of receive time."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, "60 seconds"), "stream").agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes")).select(F.col("window.start").alias("minute"), "stream", "n", "bytes")


def archive(rows: DataFrame, root: str, checkpoint: str, time: str = "ts"):
    """Starts the bronze sink: stream/date/hour partitions of gzip lines; the commit log seals files and replaces renames."""
    out = rows.withColumn("date", F.date_format(time, "yyyy-MM-dd")).withColumn("hour", F.date_format(time, "HH"))
    return out.select("value", "stream", "date", "hour").writeStream.format("text").option("compression", "gzip").option("checkpointLocation", checkpoint).partitionBy("stream", "date", "hour").option("path", root)


def routed(rows: DataFrame, root: str, checkpoint: str):
    """Starts a sink that writes the six streams of ``archive.route`` of each micro-batch apart."""

    def write(batch: DataFrame, epoch: int) -> None:
        for name in ("depth", "trades", "snapshots", "gaps", "outages", "malformed"):
            batch.where(F.col("stream") == name).write.mode("append").parquet(f"{root}/{name}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
