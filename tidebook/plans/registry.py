"""Registry of named queries, and the analogue tables they read.

The driver's ``events`` stand for the book's frames: event_type is the symbol, event_id the arrival order,
value (a cent at least) the mid, and an event whose property k is 0 breaks trust.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import frames as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, mid, user_id, ts, event_ms, k of every event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.greatest(F.col("value"), F.lit(0.01)).alias("mid"), "user_id", "ts",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("event_ms"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks with ``segment_id``; the break count is summed by bucket of positions first, so no symbol is one task."""
    rows = ticks(spark, sf_dir)
    return W.island_ids(rows, F.col("k") == 0, ["symbol"], "seq", bucket=W.seq_bucket())


#: The same tables for the oracle; queries go on with a comma or a SELECT.
TICKS = """WITH ev AS (SELECT event_type AS symbol, event_id AS seq, GREATEST(value, 0.01) AS mid, user_id, ts, epoch_us(ts) // 1000 AS event_ms,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
FRAMES = TICKS + """,
fr AS (SELECT *, CAST(SUM(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY seq) AS BIGINT) AS segment_id FROM ev),
fp AS (SELECT *, ROW_NUMBER() OVER w - 1 AS pos, COUNT(*) OVER (PARTITION BY symbol, segment_id) AS len FROM fr WINDOW w AS (PARTITION BY symbol, segment_id ORDER BY seq))"""


def forward_sql(k: int, latency: int = 0) -> str:
    """CTE fw: fp with the forward move in basis points."""
    a, b = 1 + latency, k + latency
    return FRAMES + f""",
fw AS (SELECT *, CASE WHEN COUNT(mid) OVER f = {k} THEN (AVG(mid) OVER f - entry) / entry * 1e4 END AS bp FROM
 (SELECT *, {f"LEAD(mid, {latency}) OVER (PARTITION BY symbol, segment_id ORDER BY seq)" if latency else "mid"} AS entry FROM fp)
 WINDOW f AS (PARTITION BY symbol, segment_id ORDER BY seq ROWS BETWEEN {a} FOLLOWING AND {b} FOLLOWING))"""
