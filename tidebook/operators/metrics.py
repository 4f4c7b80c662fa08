"""Classification metrics from a confusion table; every class counts, seen or not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions import scalars as S


def confusion(rows: DataFrame, truth: str = "y", guess: str = "p", keys: list[str] | None = None) -> DataFrame:
    """keys, y, p, n with all nine cells of the keys that occur."""
    keys = keys or []
    spark = rows.sparkSession
    counts = rows.groupBy(*keys, F.col(truth).cast("int").alias("y"), F.col(guess).cast("int").alias("p")).agg(F.count("*").alias("n"))
    grid = spark.range(9).select((F.col("id") / 3).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("p"))
    whole = counts.select(*keys).distinct().crossJoin(F.broadcast(grid)) if keys else grid
    return whole.join(counts, [*keys, "y", "p"], "left").na.fill(0, ["n"])


def class_scores(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, label, support, predicted, hit, precision, recall, f1; 0 where a denominator is 0."""
    keys = keys or []
    label = F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit("y").alias("side")), F.struct(F.col("p").alias("label"), F.lit("p").alias("side"))))
    long = cells.withColumn("_e", label)
    agg = long.groupBy(*keys, F.col("_e.label").alias("label")).agg(
        F.sum(F.when(F.col("_e.side") == "y", F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("_e.side") == "p", F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("_e.side") == "y") & (F.col("y") == F.col("p")), F.col("n")).otherwise(0)).alias("hit"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = agg.withColumn("precision", rate(F.col("hit"), F.col("predicted"))).withColumn("recall", rate(F.col("hit"), F.col("support")))
    return scored.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def summary(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n, accuracy, majority, macro_f1, weighted_f1."""
    total = F.sum("support")
    return scores.groupBy(*(keys or [])).agg(
        total.alias("n"),
        F.coalesce(F.try_divide(F.sum("hit"), total), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(F.max("support"), total), F.lit(0.0)).alias("majority"),
        (F.sum("f1") / 3).alias("macro_f1"),
        F.coalesce(F.try_divide(F.sum(F.col("f1") * F.col("support")), total), F.lit(0.0)).alias("weighted_f1"),
    )


def across_folds(folds: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of fold scores."""
    return folds.groupBy(*(keys or [])).agg(*(x for c in columns for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))))


def rank_correlation(rows: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Spearman's coefficient from ranks without ties averaged; equals follow ``tie``."""
    return global_rank(global_rank(rows, [x, tie], "_x"), [y, tie], "_y").agg(F.corr("_x", "_y").alias("rho"))


def global_rank(rows: DataFrame, order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """Adds the place of each row in the whole order (the last column breaks ties), without one task that sorts all.

    A bounded sample cuts the order into ranges; a row's rank is its place in its range after the rows of the ranges before.
    """
    key = F.struct(*order)
    sample = sorted(tuple(r) for r in rows.select(*order).dropna().orderBy(F.xxhash64(*order), *order).limit(16 * ranges).collect())
    cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    kinds = rows.select(key.alias("k")).schema["k"].dataType
    literal = lambda cut: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, kinds.fields, strict=True)))
    place = F.aggregate(F.array(*map(literal, cuts)), F.lit(0), lambda n, cut: n + (cut <= key).cast("int")) if cuts else F.lit(0)
    placed = rows.withColumn("_range", place)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ahead = placed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(ahead), "_range").withColumn(name, inside + F.col("_ahead")).drop("_range", "_ahead")


def best_so_far(losses: DataFrame, keys: list[str], epoch: str, loss: str, patience: int) -> DataFrame:
    """Adds ``best`` (least loss up to an epoch), ``best_epoch`` and ``stopped``: ``patience`` epochs have gone by without a better one."""
    upto = Window.partitionBy(*keys).orderBy(epoch)
    least = F.min(F.struct(F.col(loss).alias("l"), F.col(epoch).alias("e"))).over(upto)
    rows = losses.withColumn("_b", least).withColumn("best", F.col("_b.l")).withColumn("best_epoch", F.col("_b.e")).drop("_b")
    return rows.withColumn("stopped", F.max((F.col(epoch) - F.col("best_epoch") >= patience).cast("int")).over(upto) == 1)


def balance_grid(moves: DataFrame, alphas: DataFrame) -> DataFrame:
    """alpha, shares of the three classes of ``bp``, and flags where flat is over 85 % or under 10 %."""
    label = S.label_from_bp(F.col("bp"), F.col("alpha"))
    grid = moves.crossJoin(F.broadcast(alphas)).withColumn("label", label).groupBy("k", "alpha")
    out = grid.agg(*(F.avg((F.col("label") == c).cast("double")).alias(f"share_{name}") for c, name in enumerate(("down", "flat", "up"))))
    return out.withColumn("flag", F.when(F.col("share_flat") > 0.85, "too flat").when(F.col("share_flat") < 0.10, "too moving").otherwise("ok"))
