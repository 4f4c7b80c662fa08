"""The published ten-level benchmark files: 149 rows (144 features, 5 labels) by N events, features as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import frames as W

ROWS, FEATURES, HORIZONS = 149, 144, (10, 20, 30, 50, 100)
WARM_UP, LAGS, SPANS = 50, (1, 5, 10, 20, 50), (10, 50)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    """col, row, x of every cell.  A line of the file is one row of the matrix and is split inside its task."""
    lines = spark.read.text(path).withColumn("path", F.col("_metadata.file_path"))
    # the line number: lines of one file in one reader task keep their order
    numbered = lines.where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    numbered = numbered.withColumn("row", F.row_number().over(Window.partitionBy("path").orderBy("_at")).cast("int") - 1)
    return numbered.select("path", "row", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "_x")).select("path", "row", F.col("col").cast("long").alias("col"), F.col("_x").cast("double").alias("x"))


def check_rows(cells: DataFrame) -> None:
    for r in cells.groupBy("path").agg(F.countDistinct("row").alias("n")).collect():  # a row a file
        if r["n"] != ROWS:
            raise ValueError(f"{r['path']}: {r['n']} rows, not {ROWS}")


def events_of(cells: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """path, col and a column x<row> for each wanted row (the level-1 prices and the labels by default)."""
    wanted = wanted if wanted is not None else [0, 1, 2, 3, *range(FEATURES, ROWS)]
    kept = cells.where(F.col("row").isin(wanted))
    return kept.groupBy("path", "col").pivot("row", wanted).agg(F.first("x")).select("path", "col", *(F.col(str(r)).alias(f"x{r}") for r in wanted))


def joined(parts: list[DataFrame]) -> DataFrame:
    """Several files one after another: ``frame_id`` runs on, ``file`` numbers them."""
    spark = parts[0].sparkSession
    sizes = [p.agg(F.max("col")).first()[0] for p in parts]
    offsets, at = [], 0
    for n in sizes:
        offsets.append(at)
        at += (n if n is not None else -1) + 1
    out = None
    for k, (part, offset) in enumerate(zip(parts, offsets, strict=True)):
        mine = part.withColumn("file", F.lit(k)).withColumn("frame_id", F.col("col") + offset)
        out = mine if out is None else out.unionByName(mine)
    return out if out is not None else spark.createDataFrame([], "file int, frame_id long")


def segments(events: DataFrame, jump_bp: float = 100.0) -> DataFrame:
    """Adds mid, symbol and ``segment_id``: a new instrument where the mid jumps, and at every file's start."""
    rows = events.withColumn("mid", (F.col("x0") + F.col("x2")) / 2).withColumn("symbol", F.lit("fi")).withColumn("seq", F.col("frame_id"))
    rows = W.with_jumps(W.with_previous(rows, {"_file_before": F.col("file")}, ["symbol"]), F.col("mid"), ["symbol"], jump_bp)
    edge = F.col("_jump") | F.coalesce(F.col("_file_before") != F.col("file"), F.lit(False))
    return W.island_ids(rows, edge, ["symbol"], "seq", bucket=W.seq_bucket()).drop("_jump", "_file_before")


def returns(rows: DataFrame) -> DataFrame:
    """Log returns over LAGS rows and realised volatility over SPANS rows, within each instrument."""
    out = rows
    for lag in LAGS:
        out = out.withColumn(f"ret{lag}", W.lagged_return_bp(F.col("mid"), lag, 1e-12))
    out = out.withColumn("_r", W.lagged_return_bp(F.col("mid"), 1, 1e-12))
    out = W.rolling_sums(out, {f"_rv{n}": (F.col("_r") * F.col("_r"), n) for n in SPANS})
    return out.withColumns({f"rv{n}": F.sqrt(F.greatest(F.col(f"_rv{n}"), F.lit(0.0))) for n in SPANS}).drop("_r", *(f"_rv{n}" for n in SPANS))


def valid_rows(rows: DataFrame, most_k: int = HORIZONS[-1]) -> DataFrame:
    """Rows past an instrument's warm-up with ``most_k`` rows after them."""
    return W.positions(rows).where((F.col("pos") >= WARM_UP) & (F.col("pos") < F.col("len") - most_k))


def labels(rows: DataFrame) -> DataFrame:
    """y<k>: published labels recoded to 0 down, 1 flat, 2 up."""
    return rows.withColumns({f"y{k}": S.recode_three(F.col(f"x{FEATURES + i}")) for i, k in enumerate(HORIZONS)})


#: Published weighted F1 in percent by horizon; horizons left out have none.
PUBLISHED = {10: 83.40, 20: 72.82, 50: 80.35}


def against_published(spark: SparkSession, ours: DataFrame) -> DataFrame:
    """k, weighted_f1, published (null where there is none), gap."""
    table = spark.createDataFrame(pd.DataFrame({"k": list(PUBLISHED), "published": list(PUBLISHED.values())}))
    return ours.join(F.broadcast(table), "k", "left").withColumn("gap", F.col("weighted_f1") * 100 - F.col("published"))
