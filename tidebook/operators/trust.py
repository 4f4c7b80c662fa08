"""The replay's automaton over one symbol's whole history, in parallel.

A symbol's rows are cut into buckets of positions.  What a bucket does depends on the state in which it is entered, and the states that
can occur are few: dark, or synced at an id.  An id can only be that of an earlier event after which no larger id came,
for all later events were skipped.  Those ids form a short falling staircase, usually of one step.  So:

1. each bucket gives its own staircase and its trailing chain of withheld events; a scan over the buckets (small rows) carries both on;
2. each bucket is walked once for every state it may be entered in, which gives a function from entry to exit: id, segments
   and chains begun, last anchor; a scan over the buckets composes the functions from the true start;
3. each bucket is walked from its true entry and its rows are labelled.

A walk jumps: over runs of events that follow each other, to the next event with a snapshot, past skipped ones.  The snapshots that
an event could be anchored at come with it, by an equi-join on ranges of ids; of those that an anchor has used up only
*late* events know: ones whose snapshot lies below an id that the feed has passed.  Such an event is a cell of its own, decided in the
second scan, where the anchors made so far are known (again a falling staircase).

Symbols of no more events than a bucket holds, of which a table may have millions, need none of this: a task walks many of them
whole, event by event, without a pass, an array or a row of a scan for each.  Longer ones are cut into buckets that their events fill.

Rows of an exchange are ids only.  No longer symbol, segment or chain is one task's; the scans read a row or two for each bucket.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.sources import shared

#: Positions of a bucket.
BUCKET = 65_536
#: Ids of a cell on each level of the join of events with snapshots; an event is joined on the first level where it meets 16 cells at most.
LEVELS = tuple(1 << s for s in (10, 20, 30, 40, 50, 60))

ROWS = "symbol string, bucket long, seq long, kind int, first_id long, final_id long, prev_id long, more array<long>"
ENTRY, SNAPSHOT, EVENT, WITHHELD = -1, 0, 1, 2
LOWEST = -(1 << 63)

Front = list[tuple[int, int]]


class Stretch:
    """The rows of one bucket, in order of position."""

    def __init__(self, kind: np.ndarray, seq: np.ndarray, first: np.ndarray, final: np.ndarray, prev: np.ndarray, trust: bool = True, missed: tuple[int, int] | None = None, passed: int = LOWEST):
        rows = np.flatnonzero(kind >= EVENT)
        held = kind[rows] == WITHHELD
        self.rows, self.held, self.trust = seq[rows], held, trust
        own_final, own_prev = final[rows], prev[rows]
        # withheld events in a chain: the row of each chain's first one
        goes_on = np.zeros(len(rows), bool)
        goes_on[1:] = held[1:] & held[:-1] & (own_final[:-1] == own_prev[1:])
        if missed and len(rows) and held[0]:
            goes_on[0] = missed[1] == own_prev[0]
        starts = np.maximum.accumulate(np.where(held & ~goes_on, np.arange(len(rows)), -1)) if len(rows) else np.zeros(0, np.int64)
        begin = np.where(starts >= 0, own_prev[starts], missed[0] if missed else 0)
        self.tail = None
        if len(rows) and held[-1]:
            #: of the chain at the end: where it comes from, the last id, and the id it has to go on from if it fills the bucket
            whole = bool(held.all() and starts[-1] < 0) or bool(held.all() and goes_on[1:].all())
            self.tail = (int(begin[-1]), int(own_final[-1]), int(own_prev[0]) if whole else None)
        self.empty = not len(rows)

        at = np.flatnonzero(~held)
        self.at, self.n = at, len(at)
        self.seq, self.first, self.final, self.prev = self.rows[at], first[rows][at], own_final[at], own_prev[at]
        before = at - 1
        self.repairs = np.zeros(self.n, bool)
        self.repair = np.zeros(self.n, np.int64)
        ok = before >= 0
        self.repairs[ok] = held[before[ok]] & (own_final[before[ok]] == self.prev[ok])
        self.repair[ok] = begin[before[ok]]
        if self.n and at[0] == 0 and missed and missed[1] == self.prev[0]:
            self.repairs[0], self.repair[0] = True, missed[0]

        #: snapshots by event: (id, position from which it may be used), lowest first
        self.choices: dict[int, list[tuple[int, int]]] = {}
        for r in np.flatnonzero(kind == SNAPSHOT):
            k = int(np.searchsorted(self.seq, seq[r]))
            if k < self.n and self.seq[k] == seq[r]:
                self.choices.setdefault(k, []).append((int(first[r]), int(final[r])))
        for found in self.choices.values():
            found.sort()
        self.spots = sorted(self.choices)
        high = np.maximum.accumulate(np.concatenate(([passed], self.final)))[:-1] if self.n else self.final
        self.late = [k for k in self.spots if self.choices[k][0][0] < high[k]]
        follows = self.final[1:] > self.final[:-1]
        if trust:
            follows &= self.prev[1:] == self.final[:-1]
        breaks = np.concatenate((~follows, [True])) if self.n else np.zeros(0, bool)
        for k in self.late:  # a late event is a cell of its own
            breaks[k] = True
            if k:
                breaks[k - 1] = True
        self._ends = np.flatnonzero(breaks)

    def run_end(self, k: int) -> int:
        """Last event of the run that an applied event is in."""
        return int(self._ends[np.searchsorted(self._ends, k)])

    def above(self, k: int, stop: int, last: int) -> int:
        """First event from ``k`` on with a larger id."""
        step = 16
        while k < stop:
            found = np.flatnonzero(self.final[k : min(k + step, stop)] > last)
            if len(found):
                return k + int(found[0])
            k, step = k + step, step * 4
        return stop

    def cells(self) -> list[tuple[int, int]]:
        """Ranges of events without a late one, and late ones alone."""
        out, at = [], 0
        for k in self.late:
            out += [(at, k)] if at < k else []
            out.append((k, k + 1))
            at = k + 1
        return out + ([(at, self.n)] if at < self.n else [])

    def staircase(self, start: int, stop: int, before: list[int]) -> list[int]:
        """Ids, largest first, after which no larger one came: those of earlier events and of a range."""
        ids = self.final[start:stop]
        if not len(ids):
            return before
        later = np.maximum.accumulate(ids[::-1])[::-1]
        own = np.flatnonzero(np.concatenate((ids[:-1] > later[1:], [True])))
        return [x for x in before if x > later[0]] + [int(x) for x in ids[own]]

    def walk(self, last: int | None, front: Front, start: int = 0, stop: int | None = None, out: list | None = None) -> tuple[int | None, int, int, Front]:
        """(id, segments begun, chains begun, anchors that may still count) on leaving a range entered at ``last``.

        ``out`` takes pieces (from, to, outcome, segments and chains begun so far, anchor, expected id).
        """
        k, segments, chains = start, 0, 0
        stop = self.n if stop is None else stop
        say = out.append if out is not None else lambda piece: None
        while k < stop:
            if last is None:
                place, anchor = bisect.bisect_left(self.spots, k), None
                while place < len(self.spots) and self.spots[place] < stop:
                    spot = self.spots[place]
                    anchor = next((i for i, since in self.choices[spot] if not used(front, i, since)), None)
                    if anchor is not None:
                        break
                    place += 1
                if anchor is None:
                    say((k, stop, "unanchored", segments, chains, None, None))
                    break
                if spot > k:
                    say((k, spot, "unanchored", segments, chains, None, None))
                segments, chains = segments + 1, chains + 1
                front = [(t, a) for t, a in front if a > anchor] + [(int(self.seq[spot]), anchor)]
                say((spot, spot + 1, "applied", segments, chains, anchor, None))
                k = spot
            else:
                j = self.above(k, stop, last)
                if j > k:
                    say((k, j, "skipped", segments, chains, None, None))
                if j == stop:
                    break
                k = j
                if not self.trust or self.prev[k] == last:
                    say((k, k + 1, "applied", segments, chains, None, None))
                elif self.repairs[k] and self.repair[k] == last:
                    segments += 1
                    say((k, k + 1, "repaired", segments, chains, None, last))
                else:
                    say((k, k + 1, "desync", segments, chains, None, last))
                    last, k = None, k + 1
                    continue
            end = min(self.run_end(k), stop - 1)
            if end > k:
                say((k + 1, end + 1, "applied", segments, chains, None, None))
            last, k = int(self.final[end]), end + 1
        return last, segments, chains, front


def used(front: Front, snapshot: int, since: int) -> bool:
    """Whether an anchor has taken a snapshot out of the pool: one at or above it, made after it came."""
    return any(a >= snapshot and t >= since for t, a in front)


# -- rows as stretches -----------------------------------------------------------------------


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[np.ndarray], list[int] | None]]:
    """((symbol, bucket), kind and seq and ids, what the scans sent there) of sorted ``ROWS``, one bucket at a time."""
    key, held, entry = None, [], None
    whole = lambda rows: [np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*rows, strict=True)]
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        symbols = columns["symbol"].dictionary_encode()
        codes, buckets = symbols.indices.fill_null(-1).to_numpy(zero_copy_only=False), columns["bucket"].to_numpy(zero_copy_only=False)
        arrays = [columns[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("kind", "seq", "first_id", "final_id", "prev_id")]
        names = symbols.dictionary.to_pylist()
        edges = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (buckets[1:] != buckets[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mine = (names[codes[a]] if codes[a] >= 0 else None, int(buckets[a]))
            if held and mine != key:
                yield key, whole(held), entry
                held, entry = [], None
            key = mine
            if arrays[0][a] == ENTRY:
                entry = columns["more"][a].as_py()
                a += 1
            held.append([x[a:b] for x in arrays])
    if held:
        yield key, whole(held), entry


def by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("symbol", "bucket").sortWithinPartitions("symbol", "bucket", "seq", "kind")


def table_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


# -- the passes ------------------------------------------------------------------------------


def snapshot_pairs(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """symbol, seq, update_id, since: the snapshots that each event straddles and that have come before it."""
    first, final = F.col("first_id") - 1, F.col("final_id") - 1
    span = F.col("final_id") - F.col("first_id")
    level = F.lit(len(LEVELS) - 1)
    for i in reversed(range(len(LEVELS) - 1)):
        level = F.when(span <= 16 * LEVELS[i], i).otherwise(level)
    e = events.where("first_id <= final_id").select("symbol", "seq", first.alias("lo"), final.alias("hi"), level.cast("int").alias("level"))
    whole = lambda x: F.expr(f"CASE level {' '.join(f'WHEN {i} THEN {x} div {w}' for i, w in enumerate(LEVELS))} END")
    # ids are never negative but for the one before the first, whose cell is that of 0
    e = e.withColumn("cell", F.explode(F.sequence(whole("lo"), whole("hi"))))
    s = snapshots.select("symbol", "update_id", "since", F.explode(F.array(*(F.lit(i) for i in range(len(LEVELS))))).alias("level"))
    s = s.withColumn("cell", whole("update_id"))
    met = e.join(s, ["symbol", "level", "cell"]).where((F.col("lo") <= F.col("update_id")) & (F.col("update_id") <= F.col("hi")) & (F.col("since") <= F.col("seq")))
    return met.select("symbol", "seq", "update_id", "since")


def id_rows(events: DataFrame, snapshots: DataFrame, bucket: Column) -> DataFrame:
    """``ROWS`` of events, withheld ones, and the snapshots each may be anchored at (first_id the id, final_id its position)."""
    kind = F.when(F.col("withheld"), WITHHELD).otherwise(EVENT) if "withheld" in events.columns else F.lit(EVENT)
    none = F.lit(None).cast("array<long>")
    since = F.col("seq").cast("long") if "seq" in snapshots.columns else F.lit(-(1 << 62)).cast("long")
    plain = events.select("symbol", "seq", kind.cast("int").alias("kind"), "first_id", "final_id", "prev_id")
    pairs = snapshot_pairs(plain.where(F.col("kind") == EVENT), snapshots.select("symbol", since.alias("since"), "update_id").distinct())
    marks = pairs.select("symbol", "seq", F.lit(SNAPSHOT).alias("kind"), F.col("update_id").alias("first_id"), F.col("since").alias("final_id"), F.lit(0).cast("long").alias("prev_id"))
    return plain.unionByName(marks).select("symbol", bucket.alias("bucket"), "seq", "kind", "first_id", "final_id", "prev_id", none.alias("more"))


def states(rows: DataFrame, trust: bool) -> DataFrame:
    """symbol, bucket, more: the ids that each bucket may be entered at, and the withheld chain before it ([has one, from, last id, ids ...])."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, columns, _ in grouped(batches):
            s = Stretch(*columns, trust)
            tail = [0] * 5 if s.tail is None else [1, s.tail[0], s.tail[1], int(s.tail[2] is not None), s.tail[2] or 0]
            out.append((*key, [*tail, *s.staircase(0, s.n, [])]))
            if len(out) >= 1_024:
                yield table_of(out, NAMES, KINDS)
                out = []
        yield table_of(out, NAMES, KINDS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, stairs, missed, begun = None, [], None, False
        for batch in batches:
            out = []
            for sym, bucket, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or sym != symbol:
                    symbol, stairs, missed, begun = sym, [], None, True
                out.append((sym, bucket, [int(missed is not None), *(missed or (0, 0)), *stairs]))
                has_tail, begin, last, whole, head = more[:5]
                ids = more[5:]
                if ids:
                    stairs = [x for x in stairs if x > ids[0]] + ids
                if has_tail:
                    missed = (missed[0] if whole and missed and missed[1] == head else begin, last)
                else:
                    missed = None
            yield table_of(out, NAMES, KINDS)

    small = by_bucket(rows).mapInArrow(own, SMALL)
    return small.repartition("symbol").sortWithinPartitions("symbol", "bucket").mapInArrow(scan, SMALL)


SMALL, NAMES, KINDS = "symbol string, bucket long, more array<long>", ["symbol", "bucket", "more"], [pa.string(), pa.int64(), pa.list_(pa.int64())]
STEPS = "symbol string, bucket long, cell int, entry long, exit long, segments long, chains long, late boolean, more array<long>"
STEP_NAMES = ["symbol", "bucket", "cell", "entry", "exit", "segments", "chains", "late", "more"]
STEP_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]


def with_entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows with one more for each bucket, before the others, that holds what the scan sent there."""
    none = F.lit(None).cast("long")
    first = entries.select("symbol", "bucket", F.lit(LOWEST).alias("seq"), F.lit(ENTRY).alias("kind"), none.alias("first_id"), none.alias("final_id"), none.alias("prev_id"), "more")
    return by_bucket(rows.unionByName(first))


def transitions(rows: DataFrame, entered: DataFrame, trust: bool) -> DataFrame:
    """symbol, bucket, more: each bucket's true entry ([has an id, id, segments, chains begun before it, anchors ...] after the withheld chain)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, columns, more in grouped(batches):
            stairs = more[3:]
            s = Stretch(*columns, trust, (more[1], more[2]) if more[0] else None, stairs[0] if stairs else LOWEST)
            out.append((*key, -1, None, None, None, None, None, list(more[:3])))
            for number, (a, b) in enumerate(s.cells()):
                if b - a == 1 and a in s.late:
                    pairs = [x for pair in s.choices[a] for x in pair]
                    out.append((*key, number, None, None, None, None, True, [int(s.seq[a]), int(s.final[a]), int(s.prev[a]), int(s.repairs[a]), int(s.repair[a]), *pairs]))
                else:
                    for entry in (None, *stairs):
                        last, segments, chains, front = s.walk(entry, [], a, b)
                        out.append((*key, number, entry, last, segments, chains, False, [x for anchor in front[-1:] for x in anchor]))
                stairs = s.staircase(a, b, stairs)
            if len(out) >= 1_024:
                yield table_of(out, STEP_NAMES, STEP_KINDS)
                out = []
        yield table_of(out, STEP_NAMES, STEP_KINDS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, begun = None, False
        last, segments, chains, front = None, 0, 0, []
        cell = None
        for batch in batches:
            out = []
            for sym, bucket, number, entry, leave, more_segments, more_chains, late, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or sym != symbol:
                    symbol, begun, last, segments, chains, front, cell = sym, True, None, 0, 0, [], None
                if late is None:
                    # the head of a bucket, before its cells
                    out.append((sym, bucket, [*more, int(last is not None), last or 0, segments, chains, *(x for anchor in front for x in anchor)]))
                elif late:
                    seq, final, prev, repairs, repair, *pairs = more
                    if last is None:
                        anchor = next((i for i, since in zip(pairs[::2], pairs[1::2], strict=True) if not used(front, i, since)), None)
                        if anchor is not None:
                            front = [(t, a) for t, a in front if a > anchor] + [(seq, anchor)]
                            last, segments, chains = final, segments + 1, chains + 1
                    elif final > last:
                        if not trust or prev == last:
                            last = final
                        elif repairs and repair == last:
                            last, segments = final, segments + 1
                        else:
                            last = None
                elif cell != (bucket, number) and entry == last:
                    cell = (bucket, number)  # one function of the cell is the true one
                    last, segments, chains = leave, segments + more_segments, chains + more_chains
                    if more:
                        front = [(t, a) for t, a in front if a > more[1]] + [(more[0], more[1])]
            yield table_of(out, NAMES, KINDS)

    steps = with_entries(rows, entered).mapInArrow(each, STEPS)
    return steps.repartition("symbol").sortWithinPartitions("symbol", "bucket", "cell", F.col("entry").asc_nulls_first()).mapInArrow(scan, SMALL)


LABELS = "symbol string, seq long, outcome string, segment_id long, chain_id long, anchor_id long, expected long"


def label(events: DataFrame, snapshots: DataFrame, trust: bool = True, bucket: int = BUCKET) -> DataFrame:
    """``LABELS`` of every event; see ``book.label_events``.  The ids are written once, in the shared folder, since several passes read them.

    Symbols of up to ``bucket`` events are walked whole, row by row, many of them in a task; only longer ones are cut into buckets.
    """
    spark = events.sparkSession
    path = shared.new_folder(spark)
    id_rows(events, snapshots, F.floor(F.col("seq") / F.lit(bucket)).cast("long")).write.parquet(path)
    rows = spark.read.schema(ROWS).parquet(path)
    counts = rows.where(F.col("kind") >= EVENT).groupBy("symbol", "bucket").agg(F.count("*").alias("n"))
    long = counts.groupBy("symbol").agg(F.sum("n").alias("n")).where(F.col("n") > bucket).select(F.col("symbol").alias("_long"))
    if long.isEmpty():
        return walked(rows, trust)
    is_long = F.col("symbol").eqNullSafe(F.col("_long"))
    cut = path + "-long"
    filled(rows.join(long, is_long, "left_semi"), counts.join(long, is_long, "left_semi"), bucket).write.parquet(cut)
    return in_buckets(spark.read.schema(ROWS).parquet(cut), trust).unionByName(walked(rows.join(long, is_long, "left_anti"), trust))


def filled(rows: DataFrame, counts: DataFrame, bucket: int) -> DataFrame:
    """Rows with buckets of neighbouring positions put together until they hold about ``bucket`` events, so that a sparse symbol has no more buckets than its events fill."""
    before = Window.partitionBy("symbol").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    home = F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(bucket)).cast("long")
    homes = counts.select(F.col("symbol").alias("_symbol"), F.col("bucket").alias("_bucket"), home.alias("_home"))
    placed = rows.join(homes, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("bucket") == F.col("_bucket")))
    return placed.withColumn("bucket", F.col("_home")).drop("_symbol", "_bucket", "_home")


def in_buckets(rows: DataFrame, trust: bool) -> DataFrame:
    """``LABELS`` by the three passes over buckets."""
    entered = transitions(rows, states(rows, trust), trust)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for (symbol, _), columns, more in grouped(batches):
            out.append((symbol, *labelled(Stretch(*columns, trust, (more[1], more[2]) if more[0] else None), more)))
            n += len(out[-1][1])
            if n >= 16_384:
                yield label_batch(out)
                out, n = [], 0
        if out:
            yield label_batch(out)

    return with_entries(rows, entered).mapInArrow(run, LABELS)


def walked(rows: DataFrame, trust: bool) -> DataFrame:
    """``LABELS`` by the machine itself, one event after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, symbol = Walk(trust), None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            coded = columns["symbol"].dictionary_encode()
            codes, names = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            if (names[codes[0]] if codes[0] >= 0 else None) != symbol:
                walk = Walk(trust)
            ids = [columns[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("kind", "seq", "first_id", "final_id", "prev_id")]
            edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            labels: list[tuple] = []
            for number, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                walk = Walk(trust) if number else walk
                labels += walk.over(*(x[a:b].tolist() for x in ids))
            symbol = names[codes[-1]] if codes[-1] >= 0 else None
            own = np.flatnonzero(ids[0] >= EVENT)
            outcome, *found = zip(*labels, strict=True) if labels else [()] * 5
            yield labels_of(columns["symbol"].take(pa.array(own)), ids[1][own], np.array(outcome, np.int8), *(np.array(x, np.int64) for x in found))

    # a column of arrays, all null, takes longer on its way to Python than the rest of the pass
    ids = rows.drop("bucket", "more")
    return ids.repartition("symbol").sortWithinPartitions("symbol", "seq", "kind").mapInArrow(run, LABELS)


class Walk:
    """The machine of one symbol, row by row."""

    def __init__(self, trust: bool):
        self.trust = trust
        self.last: int | None = None
        self.segment = self.chain = NONE
        #: where the withheld events just before come from, and their last id
        self.missed: tuple[int, int] | None = None
        self.choices: list[tuple[int, int]] = []
        self.front: Front = []

    def over(self, kinds: list[int], seqs: list[int], firsts: list[int], finals: list[int], prevs: list[int]) -> list[tuple]:
        """(outcome, segment, chain, anchor, expected id) of the events among the next rows."""
        trust, last, segment, chain, missed, choices, front = self.trust, self.last, self.segment, self.chain, self.missed, self.choices, self.front
        out = []
        for kind, seq, first, final, prev in zip(kinds, seqs, firsts, finals, prevs, strict=True):
            if kind == SNAPSHOT:
                choices.append((first, final))
                continue
            if kind == WITHHELD:
                missed = (missed[0] if missed and missed[1] == prev else prev, final)
                out.append((HELD, segment, chain, NONE, NONE))
                continue
            if last is None:
                anchor = next((i for i, since in sorted(choices) if not used(front, i, since)), None)
                if anchor is None:
                    out.append((DARK, NONE, NONE, NONE, NONE))
                else:
                    front = [(t, a) for t, a in front if a > anchor] + [(seq, anchor)]
                    last, segment, chain = final, max(segment, -1) + 1, max(chain, -1) + 1
                    out.append((APPLIED, segment, chain, anchor, NONE))
            elif final <= last:
                out.append((SKIPPED, segment, chain, NONE, NONE))
            elif not trust or prev == last:
                last = final
                out.append((APPLIED, segment, chain, NONE, NONE))
            elif missed and missed == (last, prev):
                segment += 1
                out.append((REPAIRED, segment, chain, NONE, last))
                last = final
            else:
                out.append((DESYNC, segment, chain, NONE, last))
                last = None
            missed = None
            if choices:
                choices = []
        self.last, self.segment, self.chain, self.missed, self.choices, self.front = last, segment, chain, missed, choices, front
        return out


#: Outcomes by number.
OUTCOMES = ("withheld", "unanchored", "applied", "skipped", "repaired", "desync")
HELD, DARK, APPLIED, SKIPPED, REPAIRED, DESYNC = range(6)
NONE = LOWEST


def labelled(s: Stretch, more: list[int]) -> tuple[np.ndarray, ...]:
    """seq, outcome, segment, chain, anchor, expected id (``NONE``: none) of a bucket's rows, walked from its true entry."""
    has_last, last, segments, chains, *front = more[3:]
    pieces: list = []
    s.walk(last if has_last else None, list(zip(front[::2], front[1::2], strict=True)), out=pieces)
    n = len(s.rows)
    outcome = np.zeros(n, np.int8)
    segment, chain = np.full(n, segments - 1, np.int64), np.full(n, chains - 1, np.int64)
    anchor, expected = np.full(n, NONE, np.int64), np.full(n, NONE, np.int64)
    for a, b, name, began, chained, anchored, wanted in pieces:
        at = s.at[a:b]
        outcome[at] = OUTCOMES.index(name)
        # withheld rows after an event belong where it left the machine
        upto = s.at[b] if b < s.n else n
        segment[s.at[a] : upto], chain[s.at[a] : upto] = segments + began - 1, chains + chained - 1
        if anchored is not None:
            anchor[at] = anchored
        if wanted is not None:
            expected[at] = wanted
    dark = (outcome == OUTCOMES.index("unanchored")) | (segment < 0)
    segment[dark] = chain[dark] = NONE
    return s.rows, outcome, segment, chain, anchor, expected


def label_batch(parts: list[tuple]) -> pa.RecordBatch:
    symbols = pa.array([p[0] for p in parts], pa.string()).take(pa.array(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])))
    seq, outcome, *ids = (np.concatenate(c) for c in list(zip(*parts, strict=True))[1:])
    return labels_of(symbols, seq, outcome, *ids)


def labels_of(symbols: pa.Array, seq: np.ndarray, outcome: np.ndarray, *ids: np.ndarray) -> pa.RecordBatch:
    names = pa.DictionaryArray.from_arrays(pa.array(outcome), pa.array(OUTCOMES)).cast(pa.string())
    return pa.RecordBatch.from_arrays([symbols, pa.array(seq), names, *(pa.array(x, pa.int64(), mask=x == NONE) for x in ids)], names=["symbol", "seq", "outcome", "segment_id", "chain_id", "anchor_id", "expected"])
