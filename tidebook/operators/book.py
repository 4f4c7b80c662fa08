"""Order-book reconstruction with an explicit trust index.

A book is anchored at the first snapshot that an event straddles, follows events while each names the last
applied one as its predecessor, and goes dark at the first that does not.  The breaking event is neither applied nor
tried as an anchor.  Each stretch between breaks is a trusted segment.

The plan has two passes.  ``label_events`` carries ids only and runs the two-state automaton over buckets of positions side by
side (``operators.trust``); ``replay`` then rebuilds segments, which are independent, so one symbol's history is spread over
many tasks in both.  ``Automaton`` is the same machine event by event, for streams.

Events may be marked ``withheld``: the live book never saw them, but they were kept.  A break right after
withheld events that close it exactly is repaired: they are applied unseen, and a new segment goes on with the same book, so
such segments form one chain that is replayed together.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook import schemas
from tidebook.functions import scalars as S
from tidebook.operators import frames
from tidebook.operators import trust as trust_index

#: Levels kept on each side when it has grown to twice as many, and levels that a state shows.
KEEP, SHOWN = 500, 10


class Automaton:
    """Unsynced, or synced at the id last applied."""

    def __init__(self, trust: bool = True):
        self.trust, self.pool = trust, []
        self.last: int | None = None
        self.fresh = False
        self.segment = self.chain = -1
        self.missed: list[tuple[int, int]] = []

    def add_snapshots(self, ids: list[int]) -> None:
        self.pool = sorted({*self.pool, *ids})

    def withhold(self, final: int, prev: int) -> None:
        """An event that was lost on the way and kept elsewhere."""
        self.missed = [*self.missed, (final, prev)] if self.missed and self.missed[-1][0] == prev else [(final, prev)]

    def step(self, first: int, final: int, prev: int) -> tuple[str, int | None, int | None]:
        """(outcome, snapshot id that was loaded, expected id at a break) of one event."""
        missed, self.missed = self.missed, []
        anchor = None
        if self.last is None:
            at = bisect.bisect_left(self.pool, first - 1)
            if at == len(self.pool) or self.pool[at] + 1 > final:
                return "unanchored", None, None
            anchor = self.pool[at]
            del self.pool[: at + 1]
            self.last, self.fresh = anchor, True
            self.segment += 1
            self.chain += 1
        if final <= self.last:
            return "skipped", anchor, None
        if self.trust and not self.fresh and prev != self.last:
            expected, self.last = self.last, None
            if missed and missed[0][1] == expected and missed[-1][0] == prev:
                self.last = final
                self.segment += 1
                return "repaired", anchor, expected
            return "desync", anchor, expected
        self.last, self.fresh = final, False
        return "applied", anchor, None


def label_events(events: DataFrame, snapshots: DataFrame, trust: bool = True) -> DataFrame:
    """``outcome`` (applied, skipped, unanchored, desync, repaired, withheld), ``segment_id``, ``chain_id``, ``anchor_id``, ``expected`` by (symbol, seq).

    events: symbol, seq, first_id, final_id, prev_id; snapshots: symbol, update_id, and optionally ``seq``, the position
    from which a snapshot may be used.
    """
    return trust_index.label(events, snapshots, trust)


class Book:
    """Both sides as whole ticks to quantity."""

    def __init__(self, tick: float, keep: int = KEEP):
        self.tick, self.keep = tick, keep
        self.bids: dict[int, float] = {}
        self.asks: dict[int, float] = {}

    def ticks(self, price: str) -> int:
        return int(float(price) / self.tick + 0.5)

    def load(self, bids: list, asks: list) -> None:
        for side, levels in (("bids", bids), ("asks", asks)):
            setattr(self, side, {self.ticks(p): float(q) for p, q in levels or [] if float(q) > 0})

    def apply(self, bids: list, asks: list) -> None:
        for side, levels in ((self.bids, bids), (self.asks, asks)):
            for price, quantity in levels or []:
                at, q = self.ticks(price), float(quantity)
                if q:
                    side[at] = q
                else:
                    side.pop(at, None)
        for side, best in ((self.bids, True), (self.asks, False)):
            if len(side) > 2 * self.keep:
                for at in sorted(side, reverse=best)[self.keep :]:
                    del side[at]

    def top(self, shown: int = SHOWN) -> tuple[list[dict], list[dict]]:
        side = lambda d, best: [{"p": round(t * self.tick, 8), "q": d[t]} for t in sorted(d, reverse=best)[:shown]]
        return side(self.bids, True), side(self.asks, False)


def replay(events: DataFrame, snapshots: DataFrame, tick: float, trust: bool = True, shown: int = SHOWN, keep: int = KEEP) -> DataFrame:
    """A row of ``schemas.STATE`` for each applied or repaired event and each break.

    events: symbol, seq, event_ms, first_id, final_id, prev_id, bids, asks; snapshots: symbol, update_id, bids, asks.
    """
    columns = ["symbol", "seq", "outcome", "segment_id", "chain_id", "event_ms", "final_id", "prev_id", "expected", "anchor_id", "bids", "asks", "book_bids", "book_asks"]
    # levels go to Python as text: nested arrays, null ones too, take longer on the way than the replay itself
    texts = [F.to_json(c).alias(c) for c in ("bids", "asks")]
    books = snapshots.dropDuplicates(["symbol", "update_id"]).select("symbol", F.col("update_id").alias("anchor_id"), *(c.alias(f"book_{n}") for c, n in zip(texts, ("bids", "asks"), strict=True)))
    labels = label_events(events, snapshots, trust).where(F.col("outcome").isin("applied", "desync", "repaired", "withheld") & F.col("chain_id").isNotNull())
    rows = events.select("symbol", "seq", "event_ms", "final_id", "prev_id", *texts).join(labels, ["symbol", "seq"]).join(books, ["symbol", "anchor_id"], "left").select(columns)
    ordered = rows.repartition("symbol", "chain_id").sortWithinPartitions("symbol", "chain_id", "seq")
    level = pa.list_(pa.struct([("p", pa.float64()), ("q", pa.float64())]))
    levels = lambda text: json.loads(text) if text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, book, missed = None, Book(tick, keep), []
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for sym, seq, outcome, segment, chain, ms, final, prev, expected, anchor, bids, asks, book_bids, book_asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sym, chain) != at:
                    at, book, missed = (sym, chain), Book(tick, keep), []
                if outcome == "withheld":
                    missed.append((final, prev, bids, asks))
                    continue
                if anchor is not None:
                    book.load(levels(book_bids), levels(book_asks))
                if outcome == "repaired":
                    wanted = expected
                    for f, p, b, a in missed:
                        if p == wanted:
                            book.apply(levels(b), levels(a))
                            wanted = f
                missed = []
                state = ([], [])
                if outcome != "desync":
                    book.apply(levels(bids), levels(asks))
                    state = book.top(shown)
                broken = outcome != "applied"
                for column, value in zip(out, (sym, seq, outcome, segment, ms, final, expected if broken else None, prev if broken else None, *state), strict=True):
                    column.append(value)
            kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 5, level, level]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=schemas.STATE.fieldNames())

    return ordered.mapInArrow(run, schemas.STATE)


def top_of_deltas(deltas: DataFrame, upto, levels: int = SHOWN) -> DataFrame:
    """Relational form of the merge: the latest delta of each (symbol, side, ticks) up to a position, deletes left out, best levels ranked.

    deltas: symbol, side ('b' or 'a'), ticks, q, seq.  A partial aggregate keeps one row for each price before the exchange.
    """
    latest = deltas.where(F.col("seq") <= upto).groupBy("symbol", "side", "ticks").agg(F.max_by("q", "seq").alias("q")).where("q > 0")
    order = F.when(F.col("side") == "b", -F.col("ticks")).otherwise(F.col("ticks"))
    return latest.withColumn("level", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(order)).cast("long")).where(F.col("level") <= levels)


def price_walk(events: DataFrame, snapshots: DataFrame, steps: int | None = None) -> DataFrame:
    """symbol, steps, n_bids, n_asks, best_bid, best_ask, uncrossed: a book keyed by the prices themselves, without any check of continuity.

    A symbol's snapshot, then its first ``steps`` events (all without a bound) that end after it and after all events before, in order of ``seq``; the last quantity of a
    price counts, later entries of one event before earlier ones, and 0 deletes.  Snapshots: one row a symbol with update_id, bids, asks.
    """
    after = events.join(snapshots.select("symbol", "update_id"), "symbol").where(F.col("final_id") > F.col("update_id"))
    after = frames.with_highest_before(after, F.col("final_id"), ["symbol"], "seq", "_high").where(F.col("_high").isNull() | (F.col("final_id") > F.col("_high")))
    taken = frames.numbered(after, ["symbol"], "seq", "_step")
    taken = taken if steps is None else taken.where(F.col("_step") < steps)
    first = snapshots.withColumn("_step", F.lit(-1).cast("long"))
    level = lambda rows, c, side: rows.select("symbol", "_step", F.lit(side).alias("side"), F.posexplode(c).alias("place", "level"))
    parts = [level(rows, c, side) for rows in (first, taken) for c, side in (("bids", "b"), ("asks", "a"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    every = every.select("symbol", "_step", "side", "place", F.col("level")[0].cast("double").alias("price"), F.col("level")[1].cast("double").alias("q"))
    latest = every.groupBy("symbol", "side", "price").agg(F.max_by("q", F.struct("_step", "place")).alias("q")).where("q > 0")
    bid, ask = F.col("side") == "b", F.col("side") == "a"
    best = latest.groupBy("symbol").agg(F.count_if(bid).alias("n_bids"), F.count_if(ask).alias("n_asks"), F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"))
    walked = taken.groupBy("symbol").agg(F.count("*").alias("steps"))
    return best.join(walked, "symbol").withColumn("uncrossed", F.col("best_bid") < F.col("best_ask"))


def frame_layout(states: DataFrame, levels: int = SHOWN) -> DataFrame:
    """Adds ``frame``: ask price, ask quantity, bid price, bid quantity for each level; a short side repeats its last price at quantity 0."""

    def side(c: str, i):
        return F.coalesce(F.get(F.col(c), i), F.when(F.size(c) > 0, F.struct(F.element_at(F.col(c), -1)["p"].alias("p"), F.lit(0.0).alias("q"))))

    cells = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: F.array(side("asks", i)["p"], side("asks", i)["q"], side("bids", i)["p"], side("bids", i)["q"]))
    return states.withColumn("frame", F.transform(F.flatten(cells), lambda x: x.cast("float")))


def split_layout(frames: DataFrame) -> DataFrame:
    """Four arrays ask_p, ask_q, bid_p, bid_q from ``frame``."""
    pick = lambda k: F.filter(F.col("frame"), lambda x, i: i % 4 == k)
    return frames.withColumns({name: F.transform(pick(k), lambda x: x.cast("double")) for k, name in enumerate(("ask_p", "ask_q", "bid_p", "bid_q"))})


def faults(states: DataFrame) -> DataFrame:
    """Adds booleans empty, crossed, disordered, nonpositive."""
    bid, ask = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    ordered = lambda c, better: F.forall(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.coalesce(better(F.get(c, i - 1)["p"], F.get(c, i)["p"]), F.lit(True)))
    return states.withColumns({
        "empty": (F.size("bids") == 0) | (F.size("asks") == 0),
        "crossed": F.coalesce(bid["p"] >= ask["p"], F.lit(False)),
        "disordered": ~(ordered("bids", lambda x, y: x > y) & ordered("asks", lambda x, y: x < y)),
        "nonpositive": F.exists("bids", lambda x: x["q"] <= 0) | F.exists("asks", lambda x: x["q"] <= 0),
    })


def strict(states: DataFrame) -> DataFrame:
    """Fails the query at the first state that breaks an invariant."""
    bad = F.col("empty") | F.col("crossed") | F.col("disordered") | F.col("nonpositive")
    checked = faults(states).withColumn("_ok", F.when(bad & (F.col("outcome") == "applied"), F.raise_error(F.concat(F.lit("bad book at update "), F.col("update_id").cast("string")))).otherwise(F.lit(None)))
    return checked.where(F.col("_ok").isNull()).drop("_ok", "empty", "crossed", "disordered", "nonpositive")


def anchors(events: DataFrame, snapshots: DataFrame, bucket: int = 1_000_000) -> DataFrame:
    """Event and snapshot pairs with first_id <= update_id + 1 <= final_id, by an equi-join on id buckets."""
    lo, hi = F.floor(F.col("first_id") / bucket), F.floor(F.col("final_id") / bucket)
    left = events.withColumn("_b", F.explode(F.sequence(lo, hi)))
    right = snapshots.withColumn("_next", F.col("update_id") + 1).withColumn("_b", F.floor(F.col("_next") / bucket))
    return left.join(right, ["symbol", "_b"]).where((F.col("first_id") <= F.col("_next")) & (F.col("_next") <= F.col("final_id"))).drop("_b", "_next")


def tick_of(prices: DataFrame, price: str = "price") -> DataFrame:
    """symbol, tick, n: the greatest common divisor of the prices in units of 1e-8; distinct prices are folded, rows are not collected."""
    units = prices.select("symbol", F.round(F.col(price).cast("double") * 1e8).cast("long").alias("u")).where("u > 0").distinct()
    return gcd_by(units, "symbol", "u").select("symbol", (F.col("g") / 1e8).alias("tick"), "n")


def gcd_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, g (greatest common divisor of whole numbers), n: each task folds its rows to one number a key, the rest is a few rows."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            found = pdf.groupby(key, dropna=False)[value].agg([np.gcd.reduce, "size"]).reset_index()
            found.columns = [key, "g", "n"]
            yield found

    return rows.select(key, value).mapInPandas(run, f"{key} {kind}, g long, n long").groupBy(key).agg(S.gcd_of(F.collect_list("g")).alias("g"), F.sum("n").alias("n"))


def check_tick(prices: DataFrame, expected: float, least: int = 100) -> None:
    """Fails if the tick seen in ``least`` and more prices is not the expected one."""
    for row in tick_of(prices).collect():  # one row a symbol
        if row["n"] >= least and abs(row["tick"] - expected) > 1e-12:
            raise ValueError(f"{row['symbol']}: prices move in steps of {row['tick']}, not {expected}")


def matched_ends(trusted_ends: DataFrame, naive: DataFrame, k: int) -> DataFrame:
    """Naive frames with the update id of a trusted window end, k frames before their segment's end at least."""
    return naive.join(trusted_ends.select("symbol", "update_id").distinct(), ["symbol", "update_id"], "left_semi").where(F.col("pos") + k <= F.col("len") - 1)
