"""Scalar functions as Columns: ticks, prices, imbalance, labels, normalisation, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ticks(price: Column, tick: float) -> Column:
    """Price (string or number) to whole ticks, halves up."""
    return F.floor(price.cast("double") / F.lit(tick) + 0.5).cast("long")


def to_price(ticks: Column, tick: float) -> Column:
    return F.round(ticks * F.lit(tick), 8)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_bp(bid: Column, ask: Column) -> Column:
    return F.try_divide(ask - bid, mid(bid, ask)) * 1e4


def guarded_ratio(top: Column, bottom: Column, least: float = 1e-9) -> Column:
    """top / bottom, and 0 where the bottom is not over ``least``."""
    return F.when(bottom > least, F.try_divide(top, bottom)).otherwise(F.lit(0.0))


def imbalance(bid_qty: Column, ask_qty: Column) -> Column:
    return guarded_ratio(bid_qty - ask_qty, bid_qty + ask_qty)


def micro_price(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    return (ask * bid_qty + bid * ask_qty) / F.greatest(bid_qty + ask_qty, F.lit(1e-9))


def micro_bp(bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> Column:
    return F.try_divide(micro_price(bid, bid_qty, ask, ask_qty) - mid(bid, ask), mid(bid, ask)) * 1e4


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def level_imbalance(bids: Column, asks: Column, depth: int) -> Column:
    """Imbalance of the first ``depth`` levels of arrays of quantities."""
    return imbalance(array_sum(F.slice(bids, 1, depth)), array_sum(F.slice(asks, 1, depth)))


def depth_slope(quantities: Column, depth: int = 10) -> Column:
    """Mean level, counted from 1, weighted by quantity."""
    q = F.slice(quantities, 1, depth)
    weighted = F.aggregate(F.transform(q, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return weighted / F.greatest(array_sum(q), F.lit(1e-9))


def log_floor(x: Column, least: float = 1e-9) -> Column:
    return F.log(F.greatest(x, F.lit(least)))


def label_from_bp(bp: Column, alpha: Column | float) -> Column:
    """0 down, 1 flat, 2 up; strictly beyond the threshold."""
    alpha = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return F.when(bp > alpha, 2).when(bp < -alpha, 0).when(bp.isNotNull(), 1)


def signed_edge(prediction: Column, bp: Column) -> Column:
    """What a trade in the predicted direction earns; null where flat is predicted."""
    return F.when(prediction == 2, bp).when(prediction == 0, -bp)


def latency_frames(ms: Column, frame_ms: float = 100.0) -> Column:
    """Whole frames of a latency, halves to even."""
    return F.bround(ms / F.lit(frame_ms)).cast("int")


def transport_ms(recv_ns: Column, event_ms: Column) -> Column:
    return recv_ns / F.lit(1e6) - event_ms


def round_trip_ms(recv_ns: Column, sent_ns: Column) -> Column:
    return (recv_ns - sent_ns) / F.lit(1e6)


def period(ts: Column, seconds: int) -> Column:
    """Start of the rotation period of an epoch second."""
    return ts - F.pmod(ts, F.lit(seconds))


def z_score(x: Column, mean: Column, deviation: Column) -> Column:
    """(x - mean) / deviation, where a deviation of 1e-9 and less counts as 1."""
    return (x - mean) / F.when(deviation <= 1e-9, 1.0).otherwise(deviation)


def recode_three(label: Column) -> Column:
    """Published labels 1 up, 2 flat, 3 down to 2, 1, 0."""
    return (F.lit(3) - label).cast("int")


def interpolate(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear between two points, held at the ends."""
    inner = y0 + (y1 - y0) * (x - x0) / (x1 - x0)
    return F.when(x1.isNull() | (x1 == x0), y0).when(x0.isNull(), y1).otherwise(inner)


def normalised_window(prices: Column, quantities: Column, last_mid: Column, mean: Column, deviation: Column) -> Column:
    """Prices as basis points from the last mid, log quantities as z-scores; struct of two arrays."""
    spread = F.when(deviation <= 1e-9, 1.0).otherwise(deviation)
    return F.struct(F.transform(prices, lambda p: (p - last_mid) / last_mid * 1e4).alias("price_bp"), F.transform(quantities, lambda q: (F.log1p(q) - mean) / spread).alias("volume_z"))


def gcd_of(values: Column, steps: int = 96) -> Column:
    """Greatest common divisor of an array of whole numbers, by a bounded Euclid fold (``steps`` suffice for 64 bits)."""
    ladder = F.sequence(F.lit(1), F.lit(steps))

    def two(a: Column, b: Column) -> Column:
        start = F.struct(a.alias("a"), b.alias("b"))
        turn = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
        return F.aggregate(ladder, start, turn)["a"]

    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: two(s, F.abs(x)))


def human_bytes(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """1.5 KB, 2.0 MB ...; powers of 1024, halves to even; beyond the last unit the figure grows."""
    out = F.format_string("%.0f B", n.cast("double"))
    for power, unit in enumerate(units, 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**power)), 1))).otherwise(out)
    return out


def clock(seconds: Column) -> Column:
    """hh:mm:ss of whole seconds; hours go past 24."""
    return F.format_string("%02d:%02d:%02d", F.floor(seconds / 3_600), F.pmod(F.floor(seconds / 60), F.lit(60)), F.pmod(seconds.cast("long"), F.lit(60)))


def archive_path(stream: Column, ts: Column) -> Column:
    """stream/date=YYYY-MM-DD/hour=HH/stream-YYYYMMDDTHHMMSSZ.jsonl.gz of a timestamp in UTC."""
    return F.concat(stream, F.lit("/date="), F.date_format(ts, "yyyy-MM-dd"), F.lit("/hour="), F.date_format(ts, "HH"), F.lit("/"), stream, F.lit("-"), F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"), F.lit(".jsonl.gz"))


BARS = "▁▂▃▄▅▆▇█"


def bar(value: Column, lo: Column, hi: Column) -> Column:
    """The bar of one value between the least and the largest; the lowest one if those are equal."""
    step = F.when(hi > lo, 1).otherwise(0) * F.lit(len(BARS) - 1)
    return F.substring(F.lit(BARS), F.floor((value - lo) / F.greatest(hi - lo, F.lit(1e-300)) * step + 0.5).cast("int") + 1, F.lit(1))


def sparkline(values: Column) -> Column:
    """One bar a value, from the least to the largest; equal values are lowest bars.  The ends are taken once for each array, not once for each value."""
    whole = F.array(F.struct(values.alias("v"), F.array_min(values).alias("lo"), F.array_max(values).alias("hi")))
    return F.transform(whole, lambda s: F.array_join(F.transform(s["v"], lambda v: bar(v, s["lo"], s["hi"])), ""))[0]


def softmax(logits: Column) -> Column:
    """Struct of p (array), label (place of the largest, the first of equals) and confidence."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    p = F.transform(e, lambda x: x / array_sum(e))
    return F.struct(p.alias("p"), (F.array_position(logits, top) - 1).cast("int").alias("label"), F.array_max(p).alias("confidence"))
