"""Registered queries that run the library's own operators end to end: archive readers, layouts, features, datasets, the merged book."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebook.operators import book
from tidebook.operators import frames as W
from tidebook.plans.feeds import LINES, stored_lines, written
from tidebook.plans.registry import FRAMES, TICKS, frames, query, ticks
from tidebook.plans.relations import LEVELS, level_arrays
from tidebook.sources import archive, shared, sinks

R6 = lambda c: F.round(c, 6)


@query("s01_archive_partitions", LINES + " SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(hour(ts) AS INT) AS hour, true AS has_files, true AS has_bytes FROM ln WHERE stream = 'depth' GROUP BY ALL")
def archive_partitions(spark, d):
    """Hours of an archive on disk, by its listing."""
    found = archive.partitions(spark, written(spark, d), "stream=depth")
    return found.select("date", "hour", (F.col("n_files") > 0).alias("has_files"), (F.col("bytes") > 0).alias("has_bytes"))


def depth_archive(spark, d, by: str) -> str:
    """Root of the depth lines of an archive, filed by a time, in order of receipt inside each hour."""
    root = shared.new_folder(spark)
    rows = archive.route(stored_lines(spark, d)).where("stream = 'depth'")
    sinks.write_archive(rows.repartition(F.expr(f"{by} div 3600000000000")), root, by, "recv_ns")
    return root


@query("s04_archive_head", LINES + " SELECT symbol, seq * 10 + 10 AS final_id FROM ln WHERE stream = 'depth' ORDER BY recv_ns LIMIT 400")
def archive_head(spark, d):
    """The first records in order of files and lines."""
    return archive.parse_depth(archive.read_first_records(spark, depth_archive(spark, d, "recv_ns"), "stream=depth", 400)).select("symbol", "final_id")


@query("s06_archive_hours", LINES + ", h AS (SELECT DISTINCT date_trunc('hour', ts) AS h FROM ln WHERE stream = 'depth' ORDER BY 1 LIMIT 6) SELECT symbol, seq * 10 + 10 AS final_id FROM ln WHERE stream = 'depth' AND date_trunc('hour', ts) IN (SELECT h FROM h)")
def archive_hours(spark, d):
    """Depth events of the archive's first six hours."""
    return archive.parse_depth(archive.read_first_hours(spark, depth_archive(spark, d, "event_ns"), "stream=depth", 6)).select("symbol", "final_id")


@query("s15_newest_artifact", TICKS + " SELECT symbol, COUNT(*) AS n FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
def newest_artifact(spark, d):
    """Of one run artifact for each symbol, the one that was written last."""
    root = shared.new_folder(spark)
    for r in ticks(spark, d).groupBy("symbol").agg(F.count("*").alias("n")).orderBy("symbol").collect():  # a row for each symbol
        sinks.write_run(spark, f"{root}/{r['symbol']}", {"symbol": r["symbol"], "n": r["n"]})
    return archive.newest(spark, f"{root}/*/*.txt").select("symbol", "n")


@query("p04_split_columns", LEVELS + " SELECT k, CAST(CAST(p1 AS FLOAT) AS DOUBLE) AS p1, CAST(CAST(COALESCE(p2, pl) AS FLOAT) AS DOUBLE) AS p2, q1, COALESCE(q2, 0.0) AS q2, q1 + 1 AS b1 FROM w")
def split_columns(spark, d):
    """Frames of four levels taken apart into price and quantity columns again."""
    rows = book.split_layout(book.frame_layout(level_arrays(spark, d), 4))
    at = lambda c, i: F.get(c, F.lit(i))
    return rows.select("k", at("ask_p", 0).alias("p1"), at("ask_p", 1).alias("p2"), at("ask_q", 0).alias("q1"), at("ask_q", 1).alias("q2"), at("bid_q", 0).alias("b1"))


#: Ten levels a side around the mid, one apart, with quantities that follow k.
SIDES = " + ".join(f"(k + {i}) % 7 + 1" for i in range(5)), " + ".join(f"(k + {2 * i}) % 5 + 1" for i in range(5))


@query("w03_features", FRAMES + f""", b AS (SELECT symbol, segment_id, seq, pos, mid, k, {SIDES[0]} AS bq, {SIDES[1]} AS aq FROM fp),
l AS (SELECT *, LAG(mid) OVER w AS m0, LAG(bq) OVER w AS b0, LAG(aq) OVER w AS a0 FROM b WINDOW w AS (PARTITION BY symbol, segment_id ORDER BY seq)),
e AS (SELECT *, CASE WHEN m0 IS NULL THEN 0 ELSE CASE WHEN mid >= m0 THEN bq + a0 ELSE 0 END - CASE WHEN mid <= m0 THEN b0 + aq ELSE 0 END END AS e FROM l)
SELECT symbol, seq, CAST(SUM(e) OVER (PARTITION BY symbol, segment_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS DOUBLE) AS flow, ROUND((bq - aq) / (bq + aq), 6) AS imbalance, ROUND(2 / mid * 1e4, 6) AS spread FROM e""")
def features(spark, d):
    """The causal features of frames of ten levels: flow over five levels, imbalance of five, spread."""
    side = lambda f: F.transform(F.sequence(F.lit(0), F.lit(9)), f)
    rows = frames(spark, d).withColumns({
        "bid_p": side(lambda i: F.col("mid") - 1 - i), "ask_p": side(lambda i: F.col("mid") + 1 + i),
        "bid_q": side(lambda i: ((F.col("k") + i) % 7 + 1).cast("double")), "ask_q": side(lambda i: ((F.col("k") + 2 * i) % 5 + 1).cast("double")),
    })
    out = W.features(rows)
    return out.select("symbol", "seq", F.round("ofi5_1s", 3).alias("flow"), R6(F.col("imb5")).alias("imbalance"), R6(F.col("spread_bp")).alias("spread"))


@query("k05_dataset", FRAMES + ", n AS (SELECT symbol, segment_id, COUNT(*) AS n FROM fr GROUP BY ALL) SELECT (SELECT COUNT(*) FROM fr) AS frames, (SELECT MIN(event_ms) FROM fr) AS first_ms, (SELECT MAX(event_ms) FROM fr) AS last_ms, (SELECT COUNT(*) FROM n) AS intervals, (SELECT MAX(n) FROM n) AS longest")
def dataset(spark, d):
    """Manifest of the frames as a dataset on disk."""
    return sinks.write_dataset(frames(spark, d), shared.new_folder(spark)).select("frames", "first_ms", "last_ms", "intervals", "longest")


@query("b03_book_merge", TICKS + """, q AS (SELECT symbol, 1000 - k AS ticks, arg_max((k + seq) % 4, seq) AS q FROM ev GROUP BY ALL),
r AS (SELECT symbol, ticks, q, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY ticks DESC) AS level FROM q WHERE q > 0) SELECT symbol, CAST(level AS INT) AS level, ROUND(ticks * 0.1, 8) AS price, CAST(q AS DOUBLE) AS quantity FROM r WHERE level <= 10""")
def book_merge(spark, d):
    """The ten best bids of each symbol after its whole replay: later quantities win, 0 deletes."""
    rows = W.with_previous(ticks(spark, d), {"prev_id": F.col("seq")}, ["symbol"]).na.fill(-1, ["prev_id"])
    level = F.array(F.array(F.format_string("%.1f", F.lit(100.0) - F.col("k") / 10), ((F.col("k") + F.col("seq")) % 4).cast("string")))
    events = rows.select("symbol", "seq", "event_ms", (F.col("prev_id") + 1).alias("first_id"), F.col("seq").alias("final_id"), "prev_id", level.alias("bids"), F.expr("cast(array() as array<array<string>>)").alias("asks"))
    first = rows.groupBy("symbol").agg(F.min("seq").alias("first_seq"))
    none = F.expr("cast(array() as array<array<string>>)")
    snapshots = first.select("symbol", F.lit(-1).cast("long").alias("update_id"), none.alias("bids"), none.alias("asks"))
    states = book.replay(events, snapshots, 0.1, keep=1_000)
    last = states.groupBy("symbol").agg(F.max_by("bids", "seq").alias("bids"))
    return last.select("symbol", F.posexplode("bids").alias("i", "x")).select("symbol", (F.col("i") + 1).alias("level"), F.col("x.p").alias("price"), F.col("x.q").alias("quantity"))


@query("p15_tick_check", TICKS + " SELECT symbol, 0.01 AS tick, COUNT(DISTINCT mid) >= 100 AS enough FROM ev GROUP BY 1")
def tick_check(spark, d):
    """The ticks of each symbol's prices, after the check that none moves in other steps than a cent."""
    prices = ticks(spark, d).select("symbol", F.format_string("%.2f", "mid").alias("price"))
    book.check_tick(prices, 0.01)
    return book.tick_of(prices).select("symbol", F.lit(0.01).alias("tick"), (F.col("n") >= 100).alias("enough"))


@query("b09_price_walk", TICKS + """, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS step FROM ev),
l AS (SELECT symbol, 'b' AS side, step, (1000 - k) / 10.0 AS price, (k + seq) % 3 AS q FROM o WHERE step < 60 UNION ALL SELECT symbol, 'a', step, (1001 + k) / 10.0, seq % 2 FROM o WHERE step < 60
 UNION ALL SELECT DISTINCT symbol, 'b', -1, 50.5, 1 FROM o UNION ALL SELECT DISTINCT symbol, 'a', -1, 150.5, 1 FROM o),
q AS (SELECT symbol, side, price, arg_max(q, step) AS q FROM l GROUP BY ALL)
SELECT symbol, COUNT(*) FILTER (side = 'b') AS n_bids, COUNT(*) FILTER (side = 'a') AS n_asks, CAST(MAX(price) FILTER (side = 'b') AS DOUBLE) AS best_bid, CAST(MIN(price) FILTER (side = 'a') AS DOUBLE) AS best_ask,
 MAX(price) FILTER (side = 'b') < MIN(price) FILTER (side = 'a') AS uncrossed, (SELECT COUNT(*) FROM o WHERE o.symbol = q.symbol AND step < 60) AS steps FROM q WHERE q > 0 GROUP BY symbol""")
def price_walk(spark, d):
    """Each symbol's book by price after sixty events, with no check of continuity."""
    rows = ticks(spark, d)
    level = lambda p, q: F.array(F.array(F.format_string("%.1f", p), q.cast("string")))
    events = rows.select("symbol", "seq", F.col("seq").alias("final_id"), level(F.lit(100.0) - F.col("k") / 10, (F.col("k") + F.col("seq")) % 3).alias("bids"), level(F.lit(100.1) + F.col("k") / 10, F.col("seq") % 2).alias("asks"))
    snapshots = rows.select("symbol").distinct().select("symbol", F.lit(-1).cast("long").alias("update_id"), F.expr("array(array('50.5', '1'))").alias("bids"), F.expr("array(array('150.5', '1'))").alias("asks"))
    return book.price_walk(events, snapshots, 60)
