"""Walk-forward folds with purge and embargo, fold-local statistics, and per-instrument tails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators import frames


def fold_edges(low: int, high: int, folds: int) -> list[int]:
    """folds + 2 edges, evenly from low to high + 1, cut to whole numbers."""
    step = (high + 1 - low) / (folds + 1)
    return [int(low + step * i) for i in range(folds + 1)] + [high + 1]


def make_folds(ends: DataFrame, folds: int, k: int, purge: int | None = None, embargo: int = 0, latency: int = 0, least_train: int = 0, least_test: int = 0, position: str = "frame_id") -> DataFrame:
    """fold, role ('train' or 'test') of window ends; a training row's label ends ``purge`` (k by default) before the test block.

    Only the two ends of the positions come to the driver; the folds are a few rows that are broadcast.
    """
    spark = ends.sparkSession
    span = ends.agg(F.min(position), F.max(position)).first()
    schema = "fold int, t0 long, t1 long"
    if span[0] is None:
        params = spark.createDataFrame([], schema)
    else:
        edges = fold_edges(span[0], span[1], folds)
        params = spark.createDataFrame([(f, edges[f + 1], edges[f + 2]) for f in range(folds)], schema)
    purge = k if purge is None else purge
    x = F.col(position)
    role = F.when((x >= F.col("t0")) & (x < F.col("t1")), "test").when((x + k + latency < F.col("t0") - purge) & ~((x >= F.col("t1")) & (x < F.col("t1") + embargo)), "train")
    rows = ends.crossJoin(F.broadcast(params)).withColumn("role", role).where("role is not null").drop("t0", "t1")
    if not (least_train or least_test):
        return rows
    sizes = rows.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n1"), F.count_if(F.col("role") == "test").alias("n2")).where((F.col("n1") >= least_train) & (F.col("n2") >= least_test))
    return rows.join(F.broadcast(sizes.select("fold")), "fold", "left_semi")


def strided(rows: DataFrame, keys: list[str], order: str, stride: int) -> DataFrame:
    """Every ``stride``-th row of each key in order, the first included."""
    return frames.numbered(rows, keys, order, "_at").where(F.col("_at") % stride == 0).drop("_at")


def fold_alpha(rows: DataFrame, multiplier: float = 1.0, clip: bool = False) -> DataFrame:
    """fold, alpha: median half spread of the training rows in basis points, times the multiplier."""
    half = F.col("spread") / 2 / F.col("mid") * 1e4
    half = F.greatest(half, F.lit(0.0)) if clip else half
    return rows.where("role = 'train'").groupBy("fold").agg((F.median(half) * multiplier).alias("alpha"))


def fold_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """fold, and mean_<c>, sd_<c> of the training rows (population deviation; 1e-9 and less counts as 1)."""
    sd = lambda c: F.when(F.stddev_pop(c) <= 1e-9, 1.0).otherwise(F.stddev_pop(c))
    return rows.where("role = 'train'").groupBy("fold").agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(sd(c).alias(f"sd_{c}") for c in columns))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores of their fold's training rows."""
    stats = F.broadcast(fold_stats(rows, columns))  # a row for each fold
    out = rows.join(stats, "fold")
    return out.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in columns}).drop(*(f"{p}_{c}" for p in ("mean", "sd") for c in columns))


def tail_split(rows: DataFrame, share: float, k: int, keys: list[str], order: str = "seq") -> DataFrame:
    """role 'fit' or 'val': the last share of each key validates; the k rows before it train nothing."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    placed = frames.numbered(rows, keys, order, "_at").join(sizes, keys)
    cut = F.col("_n") - F.floor(F.col("_n") * F.lit(share))
    role = F.when(F.col("_at") >= cut, "val").when(F.col("_at") < cut - k, "fit")
    return placed.withColumn("role", role).where("role is not null").drop("_at", "_n")


def volume_stats(volumes: DataFrame, frame: str = "frame_id", quantity: str = "quantity", share: float | None = None) -> DataFrame:
    """mean, sd of log1p of the quantities, one a row: of all, or of the windows whose hash falls in a ``share``.

    The sample goes by the window, so a window's quantities are in or out together, and its size grows with the input; a partial aggregate is all that
    is shuffled.
    """
    taken = volumes if share is None else volumes.where(F.pmod(F.conv(F.substring(F.md5(F.col(frame).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)) < int(share * 1_000_000))
    return taken.agg(F.avg(F.log1p(quantity)).alias("mean"), F.stddev_pop(F.log1p(quantity)).alias("sd"))


def class_weights(rows: DataFrame, label: str, head: int = 20_000, order: str = "frame_id") -> DataFrame:
    """label, weight = n / (3 * count) over the first training rows; an absent class has weight 1."""
    spark = rows.sparkSession
    counts = rows.orderBy(order).limit(head).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    classes = spark.range(3).select(F.col("id").cast("int").alias("label"))
    joined = classes.join(counts, "label", "left").crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return joined.select("label", F.coalesce(F.col("total") / (3 * F.col("n")), F.lit(1.0)).alias("weight"))
