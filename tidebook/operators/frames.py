"""Segments and windows over frames.

A frame has a symbol, a position ``seq`` in arrival order and a mid.  No window, lag, rolling sum or label
crosses the edge of a trusted segment, so everything is partitioned by (symbol, segment_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebook.functions import scalars as S

KEYS = ("symbol", "segment_id")


def within(*keys: str, order: str = "seq") -> WindowSpec:
    return Window.partitionBy(*(keys or KEYS)).orderBy(order)


def island_ids(rows: DataFrame, breaks: Column, keys: list[str], order: str, bucket: Column | None = None, name: str = "segment_id") -> DataFrame:
    """Number of breaks up to each row, in order, for each key.

    With a ``bucket`` that grows with the order (an hour, a day) the count is local to (key, bucket), and only
    one total for each bucket is summed across, so one key's rows are spread over many tasks.
    """
    flagged = rows.withColumn("_break", breaks.cast("long"))
    if bucket is None:
        return flagged.withColumn(name, F.sum("_break").over(Window.partitionBy(*keys).orderBy(order))).drop("_break")
    flagged = flagged.withColumn("_bucket", bucket)
    totals = flagged.groupBy(*keys, "_bucket").agg(F.sum("_break").alias("_n"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = flagged.withColumn("_own", F.sum("_break").over(Window.partitionBy(*keys, "_bucket").orderBy(order)))
    return local.join(before, [*keys, "_bucket"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_break", "_bucket", "_own", "_before")


#: Positions of a bucket: rows of a key that are one task's.
BUCKET = 65_536


def seq_bucket(order: str = "seq") -> Column:
    """A bucket that grows with the order, whatever the events' own times do."""
    return F.floor(F.col(order) / F.lit(BUCKET))


def with_previous(rows: DataFrame, columns: dict[str, Column], keys: list[str], order: str = "seq") -> DataFrame:
    """Adds under each name the value of the row before, in order, of the same keys.

    A lag inside (keys, bucket of positions); a bucket's first row takes the last row of the bucket before, of which there is one
    row each, so one key's history is spread over many tasks.
    """
    placed = rows.withColumn("_bucket", seq_bucket(order)).withColumn("_own", F.struct(*(c.alias(n) for n, c in columns.items())))
    last = placed.groupBy(*keys, "_bucket").agg(F.max_by("_own", order).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    inside = F.lag("_own").over(Window.partitionBy(*keys, "_bucket").orderBy(order))
    joined = placed.withColumn("_before", inside).join(carried, [*keys, "_bucket"]).withColumn("_before", F.coalesce("_before", "_carried"))
    return joined.withColumns({n: F.col("_before")[n] for n in columns}).drop("_bucket", "_own", "_carried", "_before")


def numbered(rows: DataFrame, keys: list[str], order: str = "seq", name: str = "pos", bucket: Column | None = None) -> DataFrame:
    """Adds the place, from 0, of each row among those of its keys, in order.

    Rows are numbered inside (keys, bucket of positions) after the count of the buckets before, so one key's history is spread over many tasks.
    ``bucket`` may be another Column that grows with the order, such as a stretch of time.
    """
    placed = rows.withColumn("_bucket", seq_bucket(order) if bucket is None else bucket)
    counts = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order)) - 1
    return placed.withColumn("_own", own).join(before, [*keys, "_bucket"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_bucket", "_own", "_before")


def with_highest_before(rows: DataFrame, value: Column, keys: list[str], order: str = "seq", name: str = "highest") -> DataFrame:
    """Adds the largest value of the rows before, in order, of the same keys (null at the first one), by buckets of positions as ``numbered``."""
    placed = rows.withColumn("_bucket", seq_bucket(order)).withColumn("_value", value)
    tops = placed.groupBy(*keys, "_bucket").agg(F.max("_value").alias("_top"))
    carried = tops.withColumn("_carried", F.max("_top").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    own = F.max("_value").over(Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    joined = placed.withColumn("_own", own).join(carried, [*keys, "_bucket"])
    return joined.withColumn(name, F.greatest("_own", "_carried")).drop("_bucket", "_value", "_own", "_carried")


def haloed(rows: DataFrame, position: str = "pos", before: int = 0, after: int = 0, bucket: int = BUCKET) -> DataFrame:
    """Adds ``_bucket``, and to each bucket copies of the rows that windows of its own rows reach: ``before`` ahead of it, ``after`` behind it.

    Copies are marked ``_halo``.  A window of rows over (keys, _bucket) then sees all it would see over the keys; drop the copies after it.
    """
    b = lambda shift: F.floor((F.col(position) + shift) / F.lit(bucket))
    spread = rows.withColumn("_home", b(0)).withColumn("_bucket", F.explode(F.sequence(F.greatest(b(-after), F.lit(0)), b(before))))
    return spread.withColumn("_halo", F.col("_bucket") != F.col("_home")).drop("_home")


def with_jumps(rows: DataFrame, mid: Column, keys: list[str], jump_bp: float = 100.0, name: str = "_jump") -> DataFrame:
    """Adds ``name``: whether the log mid moves by more than ``jump_bp`` from the row before."""
    moved = with_previous(rows, {"_log_before": S.log_floor(mid)}, keys)
    return moved.withColumn(name, F.coalesce(F.abs(S.log_floor(mid) - F.col("_log_before")) * 1e4 > jump_bp, F.lit(False))).drop("_log_before")


def positions(frames: DataFrame) -> DataFrame:
    """Adds ``pos`` from 0 and ``len`` of the segment."""
    return frames.withColumn("pos", F.row_number().over(within()).cast("long") - 1).withColumn("len", F.count("*").over(Window.partitionBy(*KEYS)))


def valid_ends(frames: DataFrame, window: int, k: int, latency: int = 0) -> DataFrame:
    """Frames that end a full window and have k + latency frames after them in their segment."""
    placed = frames if "pos" in frames.columns and "len" in frames.columns else positions(frames)
    return placed.where((F.col("pos") >= window - 1) & (F.col("pos") <= F.col("len") - k - latency - 1))


def rolling_sum(x: Column, width: int) -> Column:
    """Sum of the last ``width`` rows, fewer at a segment's start."""
    return F.sum(x).over(within().rowsBetween(-(width - 1), 0))


def rolling_sums(frames: DataFrame, sums: dict[str, tuple[Column, int]]) -> DataFrame:
    """Long windows as differences of running sums: one pass whatever the width."""
    out = frames
    for name, (x, _) in sums.items():
        out = out.withColumn(f"_run_{name}", F.sum(x).over(within().rowsBetween(Window.unboundedPreceding, 0)))
    for name, (_, width) in sums.items():
        out = out.withColumn(name, F.col(f"_run_{name}") - F.coalesce(F.lag(f"_run_{name}", width).over(within()), F.lit(0.0)))
    return out.drop(*(f"_run_{name}" for name in sums))


def lagged_return_bp(mid: Column, width: int, least: float = 1e-9) -> Column:
    """Log return over ``width`` frames in basis points, 0 where there is no such frame."""
    now = S.log_floor(mid, least)
    return F.coalesce((now - F.lag(now, width).over(within())) * 1e4, F.lit(0.0))


def order_flow(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    """Order-flow imbalance against the frame before; 0 at a segment's start."""
    w = within()
    before = {k: F.lag(c).over(w) for k, c in (("b", bid), ("bq", bid_qty), ("a", ask), ("aq", ask_qty))}
    gain = F.when(bid >= before["b"], bid_qty).otherwise(0.0) - F.when(bid <= before["b"], before["bq"]).otherwise(0.0)
    loss = F.when(ask >= before["a"], before["aq"]).otherwise(0.0) - F.when(ask <= before["a"], ask_qty).otherwise(0.0)
    return F.when(before["b"].isNull(), F.lit(0.0)).otherwise(gain + loss)


def full_frame_mean(x: Column, first: int, last: int) -> Column:
    """Mean of rows first ... last around the current one, null unless all are there."""
    w = within().rowsBetween(first, last)
    return F.when(F.count(x).over(w) == last - first + 1, F.avg(x).over(w))


def forward_bp(mid: Column, k: int, latency: int = 0) -> Column:
    """Mean of the k mids after entry against the entry mid, in basis points."""
    entry = F.lead(mid, latency).over(within()) if latency else mid
    return F.try_divide(full_frame_mean(mid, 1 + latency, k + latency) - entry, entry) * 1e4


def smoothed_bp(mid: Column, k: int) -> Column:
    """Mean of the next k mids against the mean of the last k, this one included."""
    back = full_frame_mean(mid, -(k - 1), 0)
    return F.try_divide(full_frame_mean(mid, 1, k) - back, back) * 1e4


FEATURES = ("ofi1_1s", "ofi1_5s", "ofi5_1s", "imb1", "imb5", "imb10", "spread_bp", "micro_bp", "ret_1s_bp", "ret_5s_bp", "ret_30s_bp", "rv_30s_bp", "slope_bid", "slope_ask")


def features(frames: DataFrame) -> DataFrame:
    """The fourteen causal features of frames with arrays ask_p, ask_q, bid_p, bid_q (best level first)."""
    at = lambda c, i: F.get(c, F.lit(i))
    base = frames.withColumn("mid", S.mid(at("bid_p", 0), at("ask_p", 0)))
    for i in range(5):
        base = base.withColumn(f"_ofi{i}", order_flow(at("bid_p", i), at("bid_q", i), at("ask_p", i), at("ask_q", i)))
    base = base.withColumn("_ofi5", sum((F.col(f"_ofi{i}") for i in range(1, 5)), F.col("_ofi0")))
    base = base.withColumn("_step", lagged_return_bp(F.col("mid"), 1))
    summed = rolling_sums(base, {"ofi1_1s": (F.col("_ofi0"), 10), "ofi1_5s": (F.col("_ofi0"), 50), "ofi5_1s": (F.col("_ofi5"), 10), "_rv": (F.col("_step") * F.col("_step"), 300)})
    level = (at("bid_p", 0), at("bid_q", 0), at("ask_p", 0), at("ask_q", 0))
    out = summed.withColumns({
        "imb1": S.level_imbalance(F.col("bid_q"), F.col("ask_q"), 1),
        "imb5": S.level_imbalance(F.col("bid_q"), F.col("ask_q"), 5),
        "imb10": S.level_imbalance(F.col("bid_q"), F.col("ask_q"), 10),
        "spread_bp": S.spread_bp(level[0], level[2]),
        "micro_bp": S.micro_bp(*level),
        "ret_1s_bp": lagged_return_bp(F.col("mid"), 10),
        "ret_5s_bp": lagged_return_bp(F.col("mid"), 50),
        "ret_30s_bp": lagged_return_bp(F.col("mid"), 300),
        "rv_30s_bp": F.sqrt(F.greatest(F.col("_rv"), F.lit(0.0))),
        "slope_bid": S.depth_slope(F.col("bid_q")),
        "slope_ask": S.depth_slope(F.col("ask_q")),
    })
    return out.drop(*(f"_ofi{i}" for i in range(6)), "_step", "_rv")
