"""Synthetic depth streams and seeded faults, for fixtures and load tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TICK = 0.1


def history(seed: int, events: int, levels: int = 20, mid_ticks: int = 635_900, first_id: int = 1_000) -> tuple[dict, list[dict]]:
    """One snapshot and contiguous events of a random book: 1 to 6 changes a side, some removals, a drifting mid."""
    rng = np.random.default_rng(seed)
    price = lambda t: f"{t * TICK:.2f}"
    sides = {"bids": {mid_ticks - 1 - i: 1.0 + i for i in range(levels)}, "asks": {mid_ticks + 1 + i: 1.0 + i for i in range(levels)}}
    shown = lambda s, best: [[price(t), f"{sides[s][t]:.3f}"] for t in sorted(sides[s], reverse=best)]
    snapshot = {"update_id": first_id, "bids": shown("bids", True), "asks": shown("asks", False)}
    out, last, mid = [], first_id, mid_ticks
    for n in range(events):
        if rng.random() < 0.15:
            mid += int(rng.integers(-1, 2))
        first, final = last + 1, last + int(rng.integers(1, 11))
        changes = {}
        for s, sign in (("bids", -1), ("asks", 1)):
            book, mine = sides[s], []
            for t in [t for t in book if (t - mid) * sign <= 0]:  # the mid has moved over it
                del book[t]
                mine.append([price(t), "0"])
            for _ in range(int(rng.integers(1, 7))):
                t = mid + sign * int(rng.integers(1, levels + 1))
                if rng.random() < 0.12 and t in book and len(book) > 2:
                    del book[t]
                    mine.append([price(t), "0"])
                else:
                    book[t] = round(float(rng.uniform(0.001, 9.0)), 3)
                    mine.append([price(t), f"{book[t]:.3f}"])
            if not book:
                book[mid + sign] = 1.0
                mine.append([price(mid + sign), "1.000"])
            changes[s] = mine
        out.append({"seq": n, "event_ms": 1_700_000_000_000 + 100 * n, "first_id": first, "final_id": final, "prev_id": last, **changes})
        last = final
    return snapshot, out


def stream(spark: SparkSession, symbols: int, events: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(events, snapshots) of several symbols, each generated in its own task."""
    names = spark.range(symbols, numPartitions=max(1, symbols)).select(F.concat(F.lit("sym"), F.col("id")).alias("symbol"), "id")
    levels = "array<array<string>>"

    def run_events(batches):
        for pdf in batches:
            for symbol, i in zip(pdf.symbol, pdf.id, strict=True):
                yield pd.DataFrame(history(seed + int(i), events)[1]).assign(symbol=symbol)

    def run_snapshots(batches):
        for pdf in batches:
            for symbol, i in zip(pdf.symbol, pdf.id, strict=True):
                yield pd.DataFrame([history(seed + int(i), 0)[0]]).assign(symbol=symbol)

    events_df = names.mapInPandas(run_events, f"seq long, event_ms long, first_id long, final_id long, prev_id long, bids {levels}, asks {levels}, symbol string")
    return events_df, names.mapInPandas(run_snapshots, f"update_id long, bids {levels}, asks {levels}, symbol string")


def chance(*columns: str, seed: int = 0) -> Column:
    """A number from 0 to 1 that is the same for the same row on every run."""
    digest = F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def with_faults(events: DataFrame, drop: float = 0.0, duplicate: float = 0.0, reorder: float = 0.0, malformed: float = 0.0, seed: int = 0) -> DataFrame:
    """Events with seeded faults and a column ``fault``; dropped rows stay, marked, so a repair can use them.

    A duplicate comes once more right after itself; a reordered row changes places with the one behind it.
    """
    at = chance("symbol", "seq", seed=seed)
    edges = np.cumsum([drop, duplicate, reorder, malformed]).tolist()
    fault = F.when(at < edges[0], "drop").when(at < edges[1], "duplicate").when(at < edges[2], "reorder").when(at < edges[3], "malformed")
    rows = events.withColumn("fault", fault)
    place = F.col("seq") * 4 + F.when(F.col("fault") == "reorder", 5).otherwise(0)
    again = F.when(F.col("fault") == "duplicate", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_again", F.explode(again)).withColumn("arrival", place + F.col("_again")).drop("_again")
