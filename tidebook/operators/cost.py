"""Trading edge, costs, latency and block-bootstrap intervals."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import frames


#: Tasks that the resamples of a bootstrap are dealt over.
DEALT = 200


def gross_edges(rows: DataFrame, prediction: str = "p", move: str = "bp") -> DataFrame:
    """Trades (flat predictions left out) with ``edge``."""
    return rows.where(F.col(prediction) != 1).withColumn("edge", S.signed_edge(F.col(prediction), F.col(move)))


def edge_summary(rows: DataFrame, keys: list[str], prediction: str = "p", move: str = "bp") -> DataFrame:
    """keys, rows, trades, trade_rate, mean, sd and the naive 95 % interval."""
    trade = F.col(prediction) != 1
    edge = S.signed_edge(F.col(prediction), F.col(move))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(trade).alias("trades"), F.avg(edge).alias("mean"), F.stddev_pop(edge).alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("trades")
    return out.withColumns({"trade_rate": F.try_divide(F.col("trades"), F.col("n_rows")), "lo": F.col("mean") - half, "hi": F.col("mean") + half})


def net_edges(summary: DataFrame, costs: list[float], mean: str = "mean") -> DataFrame:
    """A row for each cost in basis points, with ``net``."""
    table = summary.sparkSession.createDataFrame([(float(c),) for c in costs], "cost double")
    return summary.crossJoin(F.broadcast(table)).withColumn("net", F.col(mean) - F.col("cost"))


def magnitudes(moves: DataFrame, keys: list[str], move: str = "bp", beyond: float = 10.0) -> DataFrame:
    """Percentiles of the absolute move and the share beyond a threshold."""
    size = F.abs(F.col(move))
    shares = (0.5, 0.75, 0.9, 0.95, 0.99)
    out = moves.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(size, list(shares)).alias("_p"), F.avg((size > beyond).cast("double")).alias("share_beyond"))
    return out.withColumns({f"p{round(s * 100)}": F.col("_p")[i] for i, s in enumerate(shares)}).drop("_p")


def at_latency(curve: DataFrame, ms: float, keys: list[str], x: str = "ms", y: str = "edge") -> DataFrame:
    """The curve at ``ms``, linear between its points and held at its ends."""
    under, over = F.col(x) <= ms, F.col(x) >= ms
    out = curve.groupBy(*keys).agg(F.max(F.when(under, F.col(x))).alias("x0"), F.max_by(y, F.when(under, F.col(x))).alias("y0"), F.min(F.when(over, F.col(x))).alias("x1"), F.min_by(y, F.when(over, F.col(x))).alias("y1"))
    return out.select(*keys, S.interpolate(F.lit(float(ms)), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias(y))


def block_sums(series: DataFrame, length: int, keys: list[str], order: str = "seq", value: str = "edge") -> DataFrame:
    """Sum of the ``length`` values that begin at each row, null where fewer follow; windows stay inside buckets of positions."""
    placed = frames.haloed(frames.numbered(series, keys, order, "_pos"), "_pos", after=length - 1)
    w = Window.partitionBy(*keys, "_bucket").orderBy("_pos").rowsBetween(0, length - 1)
    summed = placed.withColumn("block_sum", F.when(F.count(F.lit(1)).over(w) == length, F.sum(value).over(w)))
    return summed.where("not _halo").drop("_pos", "_bucket", "_halo")


def resample_means(values: np.ndarray, length: int, resamples: int, seed: int) -> np.ndarray:
    """Means of moving-block resamples; none under two values."""
    n = len(values)
    if n < 2:
        return np.empty(0)
    length = max(1, min(length, n))
    total = np.concatenate([[0.0], np.cumsum(values)])
    whole, rest = divmod(n, length)
    rng = np.random.default_rng(seed)
    at = rng.integers(0, n - length + 1, (resamples, whole))
    means = (total[at + length] - total[at]).sum(axis=1)
    if rest:
        at = rng.integers(0, n - rest + 1, resamples)  # the last, shorter block may begin anywhere that it fits
        means = means + total[at + rest] - total[at]
    return means / n


def bootstrap_mean(values: np.ndarray, length: int, resamples: int = 1_000, seed: int = 0, level: float = 0.95) -> tuple[float, float]:
    """Moving-block percentile interval of the mean, NaN under two values."""
    means = resample_means(values, length, resamples, seed)
    if not len(means):
        return float("nan"), float("nan")
    tail = 50 * (1 - level)
    lo, hi = np.percentile(means, [tail, 100 - tail])
    return float(lo), float(hi)


def draw(parts: list, modulus):
    """A place below ``modulus`` from 60 bits of the digest of the parts: the same draw for the same parts, on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long") % modulus


def bootstrap(series: DataFrame, keys: list[str], length: int, resamples: int = 1_000, seed: int = 0, order: str = "seq", value: str = "edge", draws: DataFrame | None = None) -> DataFrame:
    """keys, n, mean, lo, hi of each key's ordered series: moving blocks of ``length`` values, the last one shorter.

    A resample's blocks begin where a counter-based generator says: from key, resample, block and seed.  Sums of whole blocks are
    taken inside buckets of positions, that of the shorter one is a difference of running sums, carried over by a small table, and draws are
    joined to them by position: no series is ever one array or one task's, nor are the draws of a key.  ``draws`` (keys, resample, block, start) may give the
    starts instead.  Under two values there is no interval.
    """
    kept = series.where(F.col(value).isNotNull())
    placed = frames.numbered(kept, keys, order, "_pos").withColumn("_bucket", F.floor(F.col("_pos") / frames.BUCKET))
    totals = placed.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_base", F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_t")
    own = F.sum(value).over(Window.partitionBy(*keys, "_bucket").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    running = placed.withColumn("_own", own).join(before, [*keys, "_bucket"]).select(*keys, (F.col("_pos") + 1).alias("at"), "_own", "_base")
    sizes = kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    shape = sizes.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(length).cast("long"), F.col("n")))).withColumn("whole", F.floor(F.col("n") / F.col("length"))).withColumn("rest", F.col("n") % F.col("length"))
    if draws is None:
        # a few keys make all the draws, so the resamples are dealt over tasks before their blocks are
        each = shape.where("n > 1").withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).repartition(DEALT, *keys, "resample")
        whole = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1))).withColumn("size", F.col("length"))
        last = each.where("rest > 0").withColumn("block", F.col("whole")).withColumn("size", F.col("rest"))
        start = draw([F.lit(seed), *(F.col(k).cast("string") for k in keys), F.col("resample").cast("string"), F.col("block").cast("string")], F.col("n") - F.col("size") + 1)
        whole, last = whole.withColumn("start", start), last.withColumn("start", start)
    else:
        given = draws.join(shape.where("n > 1"), keys)
        whole = given.where(F.col("block") < F.col("whole"))
        last = given.where(F.col("block") >= F.col("whole")).withColumn("size", F.col("rest"))
    # whole blocks meet the sum of the values from their start on; the draws are far more than any estimate of them, so neither side is broadcast
    w = Window.partitionBy(*keys, "_bucket").orderBy("_pos").rowsBetween(0, length - 1)
    sums = frames.haloed(placed.drop("_bucket"), "_pos", after=length - 1).withColumn("_sum", F.sum(value).over(w)).where("not _halo").select(*keys, F.col("_pos").alias("start"), "_sum")
    met = whole.select(*keys, "resample", F.col("start").cast("long").alias("start")).hint("merge").join(sums, [*keys, "start"]).groupBy(*keys, "resample").agg(F.sum("_sum").alias("total"))
    # the shorter one is what the running sum gains from its start to its end; nothing lies before the first value
    ends = last.select(*keys, "resample", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(-1.0).alias("sign")), F.struct((F.col("start") + F.col("size")).alias("at"), F.lit(1.0).alias("sign")))).alias("e")).select(*keys, "resample", "e.at", "e.sign").where("at > 0")
    rest = ends.join(running, [*keys, "at"]).groupBy(*keys, "resample").agg((F.sum(F.col("sign") * F.col("_own")) + F.sum(F.col("sign") * F.col("_base"))).alias("total"))
    gained = met.unionByName(rest).groupBy(*keys, "resample").agg(F.sum("total").alias("total"))
    means = gained.join(sizes.select(*keys, "n"), keys).groupBy(*keys).agg(F.percentile(F.col("total") / F.col("n"), [0.025, 0.975]).alias("ci"))
    return sizes.join(means, keys, "left").select(*keys, "n", "mean", F.col("ci")[0].alias("lo"), F.col("ci")[1].alias("hi"))
