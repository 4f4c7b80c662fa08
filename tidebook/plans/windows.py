"""Registered window queries: returns, volatility, order flow, labels, valid ends, segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import cost, gaps
from tidebook.operators import frames as W
from tidebook.plans.registry import FRAMES, TICKS, forward_sql, frames, query, table, ticks

R6 = lambda c: F.round(c, 6)
SEG = "PARTITION BY symbol, segment_id ORDER BY seq"


@query("w09_a17_forward_move", forward_sql(10) + """
SELECT symbol, COUNT(*) AS n, ROUND(quantile_cont(ABS(bp), 0.5), 6) AS p50, ROUND(quantile_cont(ABS(bp), 0.75), 6) AS p75, ROUND(quantile_cont(ABS(bp), 0.9), 6) AS p90,
 ROUND(quantile_cont(ABS(bp), 0.95), 6) AS p95, ROUND(quantile_cont(ABS(bp), 0.99), 6) AS p99, ROUND(AVG(CASE WHEN ABS(bp) > 10 THEN 1.0 ELSE 0.0 END), 6) AS share_beyond
FROM fw WHERE pos >= 4 AND pos <= len - 11 GROUP BY symbol""")
def forward_move(spark, d):
    """How far the mid moves over the next ten frames, by symbol: the flagship."""
    rows = W.positions(frames(spark, d)).withColumn("bp", W.forward_bp(F.col("mid"), 10))
    out = cost.magnitudes(W.valid_ends(rows, 5, 10), ["symbol"])
    return out.select("symbol", "n", *(R6(F.col(c)).alias(c) for c in ("p50", "p75", "p90", "p95", "p99", "share_beyond")))


@query("w01_rolling_sum", FRAMES + f"SELECT symbol, seq, ROUND(SUM(mid) OVER ({SEG} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS s FROM fr")
def rolling_sum(spark, d):
    return frames(spark, d).select("symbol", "seq", R6(W.rolling_sum(F.col("mid"), 10)).alias("s"))


@query("w01_rolling_sum_long", FRAMES + f"SELECT symbol, seq, ROUND(SUM(mid) OVER ({SEG} ROWS BETWEEN 299 PRECEDING AND CURRENT ROW), 4) AS s FROM fr")
def rolling_sum_long(spark, d):
    """300 rows as a difference of running sums."""
    return W.rolling_sums(frames(spark, d), {"s": (F.col("mid"), 300)}).select("symbol", "seq", F.round("s", 4).alias("s"))


LINE_BOOK = """, li AS (SELECT l_orderkey AS symbol, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq,
 l_extendedprice AS ask, l_quantity AS aq, l_extendedprice * (1 - l_discount) AS bid, l_quantity * (1 + l_tax) AS bq FROM lineitem)"""


def line_quotes(spark, d):
    """Line items as quotes of a symbol per order: price and quantity of both sides."""
    li = table(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("symbol"), F.lit(0).cast("long").alias("segment_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("l_extendedprice").alias("ask"), F.col("l_quantity").alias("aq"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("bid"), (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("bq"),
    )


OFI_SQL = "WITH one AS (SELECT 1)" + LINE_BOOK + """, lg AS (SELECT *, LAG(bid) OVER w AS pb, LAG(bq) OVER w AS pbq, LAG(ask) OVER w AS pa, LAG(aq) OVER w AS paq FROM li WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
ofi AS (SELECT *, CASE WHEN pb IS NULL THEN 0.0 ELSE (CASE WHEN bid >= pb THEN bq ELSE 0 END) - (CASE WHEN bid <= pb THEN pbq ELSE 0 END)
 - (CASE WHEN ask <= pa THEN aq ELSE 0 END) + (CASE WHEN ask >= pa THEN paq ELSE 0 END) END AS e FROM lg)"""


@query("w02_order_flow", OFI_SQL + " SELECT symbol, seq, ROUND(e, 6) AS ofi FROM ofi")
def order_flow(spark, d):
    return line_quotes(spark, d).select("symbol", "seq", R6(W.order_flow(F.col("bid"), F.col("bq"), F.col("ask"), F.col("aq"))).alias("ofi"))


@query("w04_order_flow_sum", OFI_SQL + " SELECT symbol, seq, CASE WHEN ABS(s) < 1e-6 THEN 0.0 ELSE ROUND(s, 6) END AS ofi3 FROM (SELECT symbol, seq, SUM(e) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s FROM ofi)")
def order_flow_sum(spark, d):
    rows = line_quotes(spark, d).withColumn("e", W.order_flow(F.col("bid"), F.col("bq"), F.col("ask"), F.col("aq")))
    rows = rows.withColumn("s", W.rolling_sum(F.col("e"), 3))
    return rows.select("symbol", "seq", F.when(F.abs("s") < 1e-6, 0.0).otherwise(R6(F.col("s"))).alias("ofi3"))


@query("w03_multi_level_flow", "WITH one AS (SELECT 1)" + LINE_BOOK + """, lg AS (SELECT *, LAG(bq) OVER w AS b1, LAG(aq) OVER w AS a1, LAG(bq, 2) OVER w AS b2, LAG(aq, 2) OVER w AS a2 FROM li WINDOW w AS (PARTITION BY symbol ORDER BY seq))
SELECT symbol, seq, CASE WHEN ABS(f) < 1e-6 THEN 0.0 ELSE ROUND(f, 6) END AS flow FROM (SELECT *, (bq - COALESCE(b1, bq)) - (aq - COALESCE(a1, aq)) + (COALESCE(b1, 0) - COALESCE(b2, 0)) - (COALESCE(a1, 0) - COALESCE(a2, 0)) AS f FROM lg)""")
def multi_level_flow(spark, d):
    """Two levels side by side: the quote and the one before it, their changes summed."""
    w = Window.partitionBy("symbol").orderBy("seq")
    lag = lambda c, n: F.lag(c, n).over(w)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    first = (F.col("bq") - F.coalesce(lag("bq", 1), F.col("bq"))) - (F.col("aq") - F.coalesce(lag("aq", 1), F.col("aq")))
    second = (z(lag("bq", 1)) - z(lag("bq", 2))) - (z(lag("aq", 1)) - z(lag("aq", 2)))
    rows = line_quotes(spark, d).withColumn("f", first + second)
    return rows.select("symbol", "seq", F.when(F.abs("f") < 1e-6, 0.0).otherwise(R6(F.col("f"))).alias("flow"))


RET = "COALESCE((LN(GREATEST(mid, 1e-9)) - LAG(LN(GREATEST(mid, 1e-9)), {n}) OVER w) * 1e4, 0.0)"


@query("w05_lagged_returns", FRAMES + f"SELECT symbol, seq, ROUND({RET.format(n=1)}, 6) AS r1, ROUND({RET.format(n=10)}, 6) AS r10, ROUND({RET.format(n=50)}, 6) AS r50 FROM fr WINDOW w AS ({SEG})")
def lagged_returns(spark, d):
    return frames(spark, d).select("symbol", "seq", *(R6(W.lagged_return_bp(F.col("mid"), n)).alias(f"r{n}") for n in (1, 10, 50)))


@query("w06_realised_volatility", FRAMES + f""", r AS (SELECT symbol, seq, segment_id, {RET.format(n=1)} AS r FROM fr WINDOW w AS ({SEG}))
SELECT symbol, seq, ROUND(SQRT(SUM(r * r) OVER ({SEG} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), 4) AS rv FROM r""")
def realised_volatility(spark, d):
    rows = frames(spark, d).withColumn("r", W.lagged_return_bp(F.col("mid"), 1))
    return rows.select("symbol", "seq", F.round(F.sqrt(W.rolling_sum(F.col("r") * F.col("r"), 30)), 4).alias("rv"))


@query("w07_instrument_returns", FRAMES + f""", j AS (SELECT *, CAST(SUM(b) OVER (PARTITION BY symbol ORDER BY seq) AS BIGINT) AS inst FROM (SELECT *, CASE WHEN ABS(LN(mid) - LN(LAG(mid) OVER (PARTITION BY symbol ORDER BY seq))) * 1e4 > 30000 THEN 1 ELSE 0 END AS b FROM fr))
SELECT symbol, seq, inst, ROUND(COALESCE((LN(mid) - LAG(LN(mid), 5) OVER w) * 1e4, 0.0), 6) AS r5, ROUND(COALESCE((LN(mid) - LAG(LN(mid), 20) OVER w) * 1e4, 0.0), 6) AS r20 FROM j WINDOW w AS (PARTITION BY symbol, inst ORDER BY seq)""")
def instrument_returns(spark, d):
    """Returns that never span a jump of the mid, where another instrument begins."""
    rows = W.with_jumps(ticks(spark, d), F.col("mid"), ["symbol"], 30_000, "b")
    rows = W.island_ids(rows, F.col("b"), ["symbol"], "seq", bucket=W.seq_bucket())
    return rows.select("symbol", "seq", F.col("segment_id").alias("inst"), *(R6(W.lagged_return_bp(F.col("mid"), n, 1e-12)).alias(f"r{n}") for n in (5, 20)))


@query("w08_segment_breaks", TICKS + """, b AS (SELECT symbol, seq, CASE WHEN ABS(LN(mid) - LN(LAG(mid) OVER (PARTITION BY symbol ORDER BY seq))) * 1e4 > 20000 THEN 1 ELSE 0 END AS b FROM ev),
s AS (SELECT symbol, seq, SUM(b) OVER (PARTITION BY symbol ORDER BY seq) AS segment_id FROM b)
SELECT symbol, CAST(segment_id AS BIGINT) AS segment_id, MIN(seq) AS start, MAX(seq) AS stop, COUNT(*) AS n FROM s GROUP BY ALL""")
def segment_breaks(spark, d):
    rows = W.with_jumps(ticks(spark, d), F.col("mid"), ["symbol"], 20_000, "b")
    rows = W.island_ids(rows, F.col("b"), ["symbol"], "seq", bucket=W.seq_bucket())
    return rows.groupBy("symbol", "segment_id").agg(F.min("seq").alias("start"), F.max("seq").alias("stop"), F.count("*").alias("n"))


@query("w09_forward_mean", forward_sql(20) + " SELECT symbol, seq, ROUND(bp, 6) AS bp FROM fw WHERE bp IS NOT NULL")
def forward_mean(spark, d):
    return frames(spark, d).withColumn("bp", W.forward_bp(F.col("mid"), 20)).where("bp is not null").select("symbol", "seq", R6(F.col("bp")).alias("bp"))


@query("w10_smoothed_label", FRAMES + f""", m AS (SELECT *, CASE WHEN COUNT(mid) OVER f = 10 THEN AVG(mid) OVER f END AS up, CASE WHEN COUNT(mid) OVER b = 10 THEN AVG(mid) OVER b END AS back FROM fr
 WINDOW f AS ({SEG} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), b AS ({SEG} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT symbol, seq, ROUND((up - back) / back * 1e4, 6) AS bp, CASE WHEN (up - back) / back * 1e4 > 500 THEN 2 WHEN (up - back) / back * 1e4 < -500 THEN 0 ELSE 1 END AS y FROM m WHERE up IS NOT NULL AND back IS NOT NULL""")
def smoothed_label(spark, d):
    rows = frames(spark, d).withColumn("bp", W.smoothed_bp(F.col("mid"), 10)).where("bp is not null")
    return rows.select("symbol", "seq", R6(F.col("bp")).alias("bp"), S.label_from_bp(F.col("bp"), 500.0).alias("y"))


@query("w11_latency_entry", forward_sql(10, 3) + " SELECT symbol, seq, ROUND(entry, 6) AS entry, ROUND(bp, 6) AS bp FROM fw WHERE bp IS NOT NULL")
def latency_entry(spark, d):
    entry = F.lead("mid", 3).over(W.within())
    rows = frames(spark, d).withColumn("entry", entry).withColumn("bp", W.forward_bp(F.col("mid"), 10, 3)).where("bp is not null")
    return rows.select("symbol", "seq", R6(F.col("entry")).alias("entry"), R6(F.col("bp")).alias("bp"))


@query("w12_valid_ends", FRAMES + " SELECT symbol, segment_id, seq, pos FROM fp WHERE pos >= 19 AND pos <= len - 10 - 2 - 1")
def valid_ends(spark, d):
    return W.valid_ends(frames(spark, d), 20, 10, 2).select("symbol", "segment_id", "seq", "pos")


@query("w13_valid_rows", FRAMES + " SELECT symbol, segment_id, COUNT(*) AS n, MIN(seq) AS first_seq, MAX(seq) AS last_seq FROM fp WHERE pos >= 25 AND pos < len - 20 GROUP BY ALL")
def valid_rows(spark, d):
    rows = W.positions(frames(spark, d)).where((F.col("pos") >= 25) & (F.col("pos") < F.col("len") - 20))
    return rows.groupBy("symbol", "segment_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


CHAIN = TICKS + """, c AS (SELECT user_id, seq, seq AS final_id, LAG(seq) OVER (PARTITION BY user_id ORDER BY seq) AS prev_id, k FROM ev),
kept AS (SELECT * FROM c WHERE k <> 7),
ch AS (SELECT *, LAG(final_id) OVER (PARTITION BY user_id ORDER BY seq) AS expected FROM kept)"""


def chain(spark, d):
    """Each user's events as a chain of ids, with the events of property 7 lost."""
    rows = W.with_previous(ticks(spark, d), {"prev_id": F.col("seq")}, ["user_id"]).withColumn("final_id", F.col("seq"))
    return rows.where("k <> 7")


@query("w14_sequence_gaps", CHAIN + " SELECT user_id, seq, expected AS expected_prev, prev_id AS got_prev, prev_id - expected AS delta, CASE WHEN prev_id > expected THEN 'missing' ELSE 'duplicate_or_reorder' END AS kind FROM ch WHERE expected IS NOT NULL AND prev_id <> expected")
def sequence_gaps(spark, d):
    return gaps.sequence_gaps(chain(spark, d), ["user_id"]).select("user_id", "seq", "expected_prev", F.col("prev_id").alias("got_prev"), "delta", "kind")


@query("w15_trusted_segments", CHAIN + """, sg AS (SELECT user_id, seq, SUM(CASE WHEN expected IS NULL OR prev_id <> expected THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS g FROM ch)
SELECT user_id, CAST(g AS BIGINT) AS segment_id, MIN(seq) AS start, MAX(seq) AS stop, COUNT(*) AS n FROM sg GROUP BY ALL""")
def trusted_segments(spark, d):
    """Stretches of each chain without a loss."""
    rows = W.with_previous(chain(spark, d), {"before": F.col("final_id")}, ["user_id"])
    rows = W.island_ids(rows, F.col("before").isNull() | (F.col("prev_id") != F.col("before")), ["user_id"], "seq", bucket=W.seq_bucket())
    return rows.groupBy("user_id", "segment_id").agg(F.min("seq").alias("start"), F.max("seq").alias("stop"), F.count("*").alias("n"))


@query("w16_throughput", TICKS + """, h AS (SELECT symbol, CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT) AS hour_ms, COUNT(*) AS n FROM ev GROUP BY ALL)
SELECT symbol, hour_ms, n, GREATEST(n - COALESCE(LAG(n) OVER (PARTITION BY symbol ORDER BY hour_ms), n), 0) AS growth FROM h""")
def throughput(spark, d):
    rows = ticks(spark, d).groupBy("symbol", F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour_ms")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.partitionBy("symbol").orderBy("hour_ms"))
    return rows.withColumn("growth", F.greatest(F.col("n") - F.coalesce(before, F.col("n")), F.lit(0)))


@query("w17_previous_row", TICKS + " SELECT symbol, seq, seq - LAG(seq) OVER (PARTITION BY symbol ORDER BY seq) AS step, event_ms - LAG(event_ms) OVER (PARTITION BY symbol ORDER BY seq) AS wait_ms FROM ev")
def previous_row(spark, d):
    rows = W.with_previous(ticks(spark, d), {"seq_before": F.col("seq"), "ms_before": F.col("event_ms")}, ["symbol"])
    return rows.select("symbol", "seq", (F.col("seq") - F.col("seq_before")).alias("step"), (F.col("event_ms") - F.col("ms_before")).alias("wait_ms"))
