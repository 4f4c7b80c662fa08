"""Registered joins, set operations, projections, predicates, sorts and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import book, folds, gaps, quality
from tidebook.operators import frames as W
from tidebook.plans.feeds import REPLAY
from tidebook.plans.registry import FRAMES, TICKS, frames, query, table, ticks
from tidebook.sources import fi2010, simulator, sinks
from tidebook.streaming import stateful  # noqa: F401  (the streaming forms are part of the plans' surface)

R6 = lambda c: F.round(c, 6)
HOUR = "CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT)"

# -- scans -----------------------------------------------------------------------------------


@query("s01_partitions", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS INT) AS hour, COUNT(*) AS n, CAST(SUM(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY ALL")
def partitions(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").groupBy(F.date_format(ts, "yyyy-MM-dd").alias("date"), F.hour(ts).alias("hour")).agg(F.count("*").alias("n"), F.sum(F.octet_length("props").cast("long")).alias("bytes"))


@query("s04_first_records", "SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 400")
def first_records(spark, d):
    return table(spark, d, "events").orderBy("ts", "event_id").limit(400).select("event_id", "user_id", "value")


@query("s06_first_hours", TICKS + f", h AS (SELECT DISTINCT {HOUR} AS h FROM ev ORDER BY 1 LIMIT 6) SELECT symbol, seq, mid FROM ev WHERE {HOUR} IN (SELECT h FROM h)")
def first_hours(spark, d):
    rows = ticks(spark, d).withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return rows.join(F.broadcast(rows.select("hour").distinct().orderBy("hour").limit(6)), "hour", "left_semi").select("symbol", "seq", "mid")


@query("s14_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def pruned_scan(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").where("o_totalprice > 400000")


@query("s15_newest_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def newest_per_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("s09_synthetic_book")
def synthetic_book(spark, d):
    """A seeded stream of two symbols, replayed into states."""
    events, snapshots = simulator.stream(spark, 2, 300)
    return book.replay(events, snapshots, simulator.TICK).select("symbol", "seq", "outcome", "segment_id", "update_id", F.get("bids", F.lit(0))["p"].alias("bid"), F.get("asks", F.lit(0))["p"].alias("ask"))


@query("st01_book_replay", REPLAY + " SELECT CAST(user_id AS VARCHAR) AS symbol, seg AS segment_id, COUNT(*) FILTER (outcome = 'applied') AS applied, COUNT(*) FILTER (outcome = 'desync') AS breaks, MIN(seq) AS start, MAX(seq) AS stop FROM m WHERE outcome <> 'unanchored' GROUP BY ALL")
def book_replay(spark, d):
    """Each user's chain as depth events: a lost event breaks trust, a snapshot anchors again."""
    rows = W.with_previous(ticks(spark, d), {"prev_id": F.col("seq")}, ["user_id"]).na.fill(-1, ["prev_id"])
    level = lambda p, q: F.array(F.array(F.format_number(p, 1).cast("string"), q.cast("string")))
    events = rows.select(F.col("user_id").cast("string").alias("symbol"), "seq", "event_ms", (F.col("prev_id") + 1).alias("first_id"), F.col("seq").alias("final_id"), "prev_id", level(F.lit(100.0) - F.col("k") / 10, F.col("k") % 5).alias("bids"), level(F.lit(100.1) + F.col("k") / 10, F.col("k") % 7).alias("asks"), "k")
    snapshots = events.where("k % 20 = 3").select("symbol", "seq", F.col("prev_id").alias("update_id"), F.expr("array(array('99.9', '1'))").alias("bids"), F.expr("array(array('100.2', '1'))").alias("asks"))
    states = book.replay(events.where("k <> 7").drop("k"), snapshots, 0.1)
    return states.groupBy("symbol", "segment_id").agg(F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "desync").alias("breaks"), F.min("seq").alias("start"), F.max("seq").alias("stop"))


@query("b03_latest_levels", TICKS + ", l AS (SELECT user_id, symbol, arg_max(k, seq) AS q FROM ev GROUP BY ALL) SELECT user_id, symbol, q FROM l WHERE q % 10 <> 0")
def latest_levels(spark, d):
    """Last write wins for each (user, price level); a quantity that ends in 0 deletes."""
    return ticks(spark, d).groupBy("user_id", "symbol").agg(F.max_by("k", "seq").alias("q")).where("q % 10 <> 0")


DELTA = """WITH dl AS (SELECT l_suppkey AS symbol, CASE WHEN l_linenumber % 2 = 0 THEN 'b' ELSE 'a' END AS side, CAST(FLOOR(l_extendedprice / 1000) AS BIGINT) AS ticks, l_quantity - 10 AS q,
 ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax) AS seq FROM lineitem)"""


def deltas(spark, d):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("symbol"), F.when(F.col("l_linenumber") % 2 == 0, "b").otherwise("a").alias("side"), F.floor(F.col("l_extendedprice") / 1000).alias("ticks"), (F.col("l_quantity") - 10).alias("q"), F.row_number().over(order).cast("long").alias("seq"))


@query("t01_top_of_book", DELTA + """, la AS (SELECT symbol, side, ticks, arg_max(q, seq) AS q FROM dl WHERE seq <= 500 GROUP BY ALL)
SELECT symbol, side, ticks, q, ROW_NUMBER() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'b' THEN -ticks ELSE ticks END) AS level FROM la WHERE q > 0 QUALIFY level <= 10""")
def top_of_book(spark, d):
    """The ten best levels of each supplier's book after 500 deltas; quantities of 10 and less delete."""
    return book.top_of_deltas(deltas(spark, d), 500)


# -- joins -----------------------------------------------------------------------------------


@query("j01_interval_anchor", """WITH sn AS (SELECT event_id AS update_id, event_type AS symbol FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 3),
e AS (SELECT event_type AS symbol, event_id AS final_id, COALESCE(LAG(event_id) OVER (PARTITION BY event_type ORDER BY event_id) + 1, 0) AS first_id FROM events)
SELECT e.symbol, e.final_id, sn.update_id FROM e JOIN sn ON e.symbol = sn.symbol AND e.first_id <= sn.update_id + 1 AND sn.update_id + 1 <= e.final_id""")
def interval_anchor(spark, d):
    """The event that straddles each snapshot, by an equi-join on id buckets."""
    rows = ticks(spark, d)
    placed = W.with_previous(rows, {"before": F.col("seq")}, ["symbol"])
    events = placed.select("symbol", F.col("seq").alias("final_id"), F.coalesce(F.col("before") + 1, F.lit(0)).alias("first_id"))
    snapshots = rows.where("k = 3").select("symbol", F.col("seq").alias("update_id"))
    return book.anchors(events, snapshots, 1_000).select("symbol", "final_id", "update_id")


@query("j02_available_snapshots", f"WITH s AS (SELECT event_type AS symbol, {HOUR} AS h, COUNT(*) AS c FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) = 3 GROUP BY ALL), e AS (SELECT event_type AS symbol, {HOUR} AS hour_ms, COUNT(*) AS n FROM events GROUP BY ALL) SELECT e.symbol, hour_ms, n, CAST(COALESCE(SUM(c), 0) AS BIGINT) AS available FROM e LEFT JOIN s ON s.symbol = e.symbol AND s.h <= e.hour_ms GROUP BY ALL")
def available_snapshots(spark, d):
    """Snapshots of partitions up to each hour: a running sum instead of a range join."""
    rows = ticks(spark, d).groupBy("symbol", F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour_ms")).agg(F.count("*").alias("n"), F.count_if(F.col("k") == 3).alias("c"))
    upto = Window.partitionBy("symbol").orderBy("hour_ms").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("symbol", "hour_ms", "n", F.sum("c").over(upto).alias("available"))


@query("j03_twin_frames", FRAMES + ", t AS (SELECT symbol, seq FROM fp WHERE pos >= 4 AND pos <= len - 11 AND k <> 7) SELECT fp.symbol, fp.seq, fp.pos FROM fp SEMI JOIN t ON t.symbol = fp.symbol AND t.seq = fp.seq WHERE pos + 10 <= len - 1")
def twin_frames(spark, d):
    naive = W.positions(frames(spark, d)).withColumn("update_id", F.col("seq"))
    trusted = W.valid_ends(frames(spark, d), 5, 10).where("k <> 7").select("symbol", F.col("seq").alias("update_id"))
    return book.matched_ends(trusted, naive, 10).select("symbol", "seq", "pos")


@query("j04_gather", "SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, o.o_custkey, o.o_totalprice FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_totalprice > 450000")
def gather(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(o, "l_orderkey")


@query("j05_never_seen", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def never_seen(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey", "left_anti")


@query("j06_losses_on_hours", TICKS + f", h AS (SELECT {HOUR} AS hour_ms, COUNT(*) AS n FROM ev GROUP BY 1), l AS (SELECT {HOUR} AS hour_ms, COUNT(*) AS lost FROM ev WHERE k = 0 GROUP BY 1) SELECT hour_ms, n, COALESCE(lost, 0) AS lost FROM h LEFT JOIN l USING (hour_ms) ORDER BY hour_ms DESC LIMIT 96")
def losses_on_hours(spark, d):
    """The last 96 hours with their losses."""
    rows = ticks(spark, d).withColumn("hour_ms", F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))))
    lost = rows.where("k = 0").groupBy("hour_ms").agg(F.count("*").alias("lost"))
    return rows.groupBy("hour_ms").agg(F.count("*").alias("n")).join(lost, "hour_ms", "left").na.fill(0, ["lost"]).orderBy(F.desc("hour_ms")).limit(96)


@query("j08_published", "WITH o AS (SELECT CAST(UNNEST([10, 20, 30, 50, 100]) AS BIGINT) AS k), p AS (SELECT * FROM (VALUES (10, 83.40), (20, 72.82), (50, 80.35)) t(k, published)) SELECT o.k, o.k / 200.0 AS weighted_f1, CAST(published AS DOUBLE) AS published, ROUND(o.k / 2.0 - published, 6) AS gap FROM o LEFT JOIN p ON p.k = o.k")
def published(spark, d):
    ours = spark.createDataFrame([(k, k / 200.0) for k in fi2010.HORIZONS], "k long, weighted_f1 double")
    return fi2010.against_published(spark, ours).withColumn("gap", R6(F.col("gap")))


@query("j09_division", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1 HAVING COUNT(DISTINCT l_returnflag) = 3")
def division(spark, d):
    """Suppliers with lines of every return flag."""
    li = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("have"), F.count("*").alias("n"))
    return li.where(F.size(F.array_except(F.array(*map(F.lit, "ANR")), "have")) == 0).select("l_suppkey", "n")


@query("j10_arm_pairing", "SELECT l_returnflag AS p, ROUND(SUM(l_quantity) FILTER (l_linestatus = 'O'), 2) AS naive, ROUND(SUM(l_quantity) FILTER (l_linestatus = 'F'), 2) AS trusted, ROUND(SUM(l_quantity) FILTER (l_linestatus = 'O') - SUM(l_quantity) FILTER (l_linestatus = 'F'), 2) AS inflation FROM lineitem GROUP BY 1")
def arm_pairing(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("p")).pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))
    return li.select("p", F.round("O", 2).alias("naive"), F.round("F", 2).alias("trusted"), F.round(F.col("O") - F.col("F"), 2).alias("inflation"))


@query("j11_diagnosis", "WITH up AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_suppkey % 3 = 0) SELECT n.n_nationkey, CASE WHEN up.k IS NULL THEN 'never_connected' ELSE 'silent' END AS cause FROM nation n LEFT JOIN up ON up.k = n.n_nationkey WHERE n.n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 40 = 0)")
def diagnosis(spark, d):
    """Nations expected and never seen, and whether any supplier was up."""
    expected = table(spark, d, "nation").select(F.col("n_nationkey").alias("stream"), F.col("n_nationkey").alias("endpoint"))
    seen = table(spark, d, "customer").where("c_custkey % 40 = 0").select(F.col("c_nationkey").alias("stream"))
    up = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("endpoint"))
    return gaps.missing_streams(expected, seen, up).select(F.col("stream").alias("n_nationkey"), "cause")


# -- projections and predicates ----------------------------------------------------------------


@query("p02_routing", "SELECT CASE WHEN ends_with(event_type, 'up') THEN 'trades' ELSE 'depth' END AS stream, COUNT(*) AS n FROM events GROUP BY 1")
def routing(spark, d):
    return table(spark, d, "events").groupBy(F.when(F.col("event_type").endswith("up"), "trades").otherwise("depth").alias("stream")).agg(F.count("*").alias("n"))


LEVELS = """WITH r AS (SELECT l_orderkey AS k, l_extendedprice AS p, l_quantity AS q, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_quantity, l_partkey) AS i FROM lineitem),
w AS (SELECT k, COUNT(*) AS n, """ + ", ".join(f"MAX(p) FILTER (i = {i}) AS p{i}, MAX(q) FILTER (i = {i}) AS q{i}" for i in range(1, 5)) + ", MAX(p) FILTER (i <= 4) AS pl FROM r GROUP BY k)"


def level_arrays(spark, d):
    """Each order's lines as ask levels, best price first, bids at 0.9 of them."""
    li = table(spark, d, "lineitem")
    lines = F.array_sort(F.collect_list(F.struct(F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("k"))))
    levels = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(lines, lambda x: F.struct(x["p"].alias("p"), x["q"].alias("q"))).alias("asks"))
    return levels.withColumn("bids", F.transform("asks", lambda x: F.struct((x["p"] * 0.9).alias("p"), (x["q"] + 1).alias("q"))))


@query("p03_frame_layout", LEVELS + " SELECT k, " + ", ".join(f"CAST(CAST(COALESCE(p{i}, pl) AS FLOAT) AS DOUBLE) AS ap{i}, COALESCE(q{i}, 0.0) AS aq{i}" for i in range(1, 5)) + " FROM w")
def frame_layout(spark, d):
    """Four ask levels; a short side repeats its last price at quantity 0."""
    rows = book.frame_layout(level_arrays(spark, d), 4)
    at = lambda i: F.element_at("frame", i).cast("double")
    return rows.select("k", *(c for i in range(4) for c in (at(4 * i + 1).alias(f"ap{i + 1}"), at(4 * i + 2).alias(f"aq{i + 1}"))))


@query("p04_layout_split", LEVELS + " SELECT k, n, " + ", ".join(f"p{i}, q{i}" for i in range(1, 3)) + " FROM w")
def layout_split(spark, d):
    rows = level_arrays(spark, d)
    at = lambda i: F.get("asks", F.lit(i - 1))
    return rows.select("k", F.size("asks").cast("long").alias("n"), *(c for i in (1, 2) for c in (at(i)["p"].alias(f"p{i}"), at(i)["q"].alias(f"q{i}"))))


@query("p07_positive_levels", "SELECT l_orderkey AS k, COUNT(*) FILTER (l_quantity > 25) AS n FROM lineitem GROUP BY 1")
def positive_levels(spark, d):
    return level_arrays(spark, d).select("k", F.size(F.filter("asks", lambda x: x["q"] > 25)).cast("long").alias("n"))


@query("p08_stale_events", TICKS + ", m AS (SELECT symbol, seq, (seq * 7919) % 1000 AS id FROM ev), r AS (SELECT *, MAX(id) OVER (PARTITION BY symbol, seq // 500 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m) SELECT symbol, COUNT(*) FILTER (id <= best) AS skipped, COUNT(*) FILTER (best IS NULL OR id > best) AS applied FROM r GROUP BY 1")
def stale_events(spark, d):
    """Events at or under the largest id so far are stale."""
    before = Window.partitionBy("symbol", F.floor(F.col("seq") / 500)).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = ticks(spark, d).withColumn("id", F.col("seq") * 7919 % 1000).withColumn("best", F.max("id").over(before))
    return rows.groupBy("symbol").agg(F.count_if(F.col("id") <= F.col("best")).alias("skipped"), F.count_if(F.col("best").isNull() | (F.col("id") > F.col("best"))).alias("applied"))


@query("p09_invariants", LEVELS + ", d AS (SELECT k, COUNT(*) AS n, COUNT(DISTINCT p) AS u, MAX(CASE WHEN q <= 2 THEN 1 ELSE 0 END) AS low, MIN(p) AS p1 FROM r GROUP BY k) SELECT k, u < n AS disordered, low = 1 AS nonpositive, n = 0 AS empty FROM d")
def invariants(spark, d):
    rows = level_arrays(spark, d).withColumn("asks", F.transform("asks", lambda x: F.struct(x["p"].alias("p"), (x["q"] - 2).alias("q"))))
    rows = book.faults(rows.withColumn("bids", F.expr("array(named_struct('p', 0.0D, 'q', 1.0D))")))
    return rows.select("k", "disordered", "nonpositive", "empty")


@query("p10_crossed", "SELECT l_returnflag AS symbol, COUNT(*) FILTER (l_tax - l_discount <= 0) AS crossed, COUNT(*) AS n FROM lineitem GROUP BY 1")
def crossed(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("symbol")).agg(F.count_if(F.col("l_tax") - F.col("l_discount") <= 0).alias("crossed"), F.count("*").alias("n"))


@query("p11_finite", "WITH x AS (SELECT CASE WHEN value > 100 THEN CAST('inf' AS DOUBLE) WHEN value < 1 THEN CAST('nan' AS DOUBLE) ELSE value END AS x FROM events) SELECT COUNT(*) FILTER (NOT isfinite(x)) AS bad, COUNT(*) AS n FROM x")
def finite(spark, d):
    x = F.when(F.col("value") > 100, float("inf")).when(F.col("value") < 1, float("nan")).otherwise(F.col("value"))
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    return table(spark, d, "events").select(x.alias("x")).agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"))


@query("p12_stride", TICKS + ", r AS (SELECT symbol, seq, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS i FROM ev WHERE k > 10) SELECT symbol, seq FROM r WHERE i % 10 = 0")
def stride(spark, d):
    return folds.strided(ticks(spark, d).where("k > 10"), ["symbol"], "seq", 10).select("symbol", "seq")


@query("p13_least_size", FRAMES + " SELECT symbol, segment_id, COUNT(*) AS n FROM fr GROUP BY ALL HAVING COUNT(*) >= 50")
def least_size(spark, d):
    return frames(spark, d).groupBy("symbol", "segment_id").agg(F.count("*").alias("n")).where("n >= 50")


@query("p16_symbol_lookup", "WITH t AS (SELECT * FROM (VALUES ('A', 0.1), ('N', 0.01), ('R', 0.001)) t(symbol, tick)) SELECT l_returnflag AS symbol, CAST(t.tick AS DOUBLE) AS tick, COUNT(*) AS n FROM lineitem JOIN t ON t.symbol = l_returnflag GROUP BY ALL")
def symbol_lookup(spark, d):
    ticks_of = spark.createDataFrame([("A", 0.1), ("N", 0.01), ("R", 0.001)], "symbol string, tick double")
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol")).join(F.broadcast(ticks_of), "symbol").groupBy("symbol", "tick").agg(F.count("*").alias("n"))


# -- sorts and sets ----------------------------------------------------------------------------


@query("t05_last_hours", TICKS + f" SELECT {HOUR} AS hour_ms, COUNT(*) AS n FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 48")
def last_hours(spark, d):
    return ticks(spark, d).groupBy(F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour_ms")).agg(F.count("*").alias("n")).orderBy(F.desc("hour_ms")).limit(48)


@query("t06_most_common", "SELECT source, CAST(SUM(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def most_common(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).orderBy(F.desc("bytes"), "source").limit(10)


@query("t07_best_horizon", "SELECT o_orderpriority, o_orderkey AS best FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_horizon(spark, d):
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(best.alias("b")).select("o_orderpriority", (-F.col("b.k")).alias("best"))


@query("t08_longest_interval", FRAMES + ", n AS (SELECT symbol, segment_id, COUNT(*) AS n FROM fr GROUP BY ALL) SELECT symbol, segment_id, n FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY n DESC, segment_id) = 1")
def longest_interval(spark, d):
    n = frames(spark, d).groupBy("symbol", "segment_id").agg(F.count("*").alias("n"))
    best = n.groupBy("symbol").agg(F.max(F.struct("n", (-F.col("segment_id")).alias("s"))).alias("b"))
    return best.select("symbol", (-F.col("b.s")).alias("segment_id"), F.col("b.n").alias("n"))


@query("t09_downsample", TICKS + ", p AS (SELECT symbol, seq, mid, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM ev) SELECT symbol, seq, mid FROM p WHERE i % GREATEST(n // 90, 1) = 0")
def downsample(spark, d):
    rows = W.numbered(ticks(spark, d), ["symbol"], "seq", "i")
    rows = rows.join(rows.groupBy("symbol").agg(F.count("*").alias("n")), "symbol")
    return rows.where(F.col("i") % F.greatest(F.floor(F.col("n") / 90), F.lit(1)) == 0).select("symbol", "seq", "mid")


@query("u02_union_offset", TICKS + ", m AS (SELECT MAX(seq) + 1 AS o FROM ev WHERE k < 50) SELECT seq AS frame_id, 0 AS file, mid FROM ev WHERE k < 50 UNION ALL SELECT seq + m.o, 1, mid FROM ev, m WHERE k >= 50")
def union_offset(spark, d):
    rows = ticks(spark, d)
    parts = [rows.where(c).select(F.col("seq").alias("col"), "mid") for c in ("k < 50", "k >= 50")]
    return fi2010.joined(parts).select("frame_id", "file", "mid")


@query("u03_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def difference(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id")).distinct()


@query("u04_cut_points", TICKS + " SELECT seq FROM ev WHERE k = 0 UNION SELECT seq FROM ev WHERE mid > 100 UNION SELECT MIN(seq) FROM ev GROUP BY symbol")
def cut_points(spark, d):
    rows = ticks(spark, d)
    return rows.where("k = 0").select("seq").union(rows.where("mid > 100").select("seq")).union(rows.groupBy("symbol").agg(F.min("seq").alias("seq")).select("seq")).distinct()


@query("u05_superset", "SELECT user_id FROM events GROUP BY 1 HAVING COUNT(DISTINCT event_type) FILTER (event_type IN ('click', 'error', 'view')) = 3")
def superset(spark, d):
    want = F.array(*map(F.lit, ("click", "error", "view")))
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("have")).where(F.size(F.array_except(want, "have")) == 0).select("user_id")


@query("u07_distinct_hours", f"SELECT DISTINCT event_type AS symbol, {HOUR} AS hour_ms FROM events")
def distinct_hours(spark, d):
    return ticks(spark, d).select("symbol", F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour_ms")).distinct()


# -- scalars -----------------------------------------------------------------------------------


@query("i01_ticks", "SELECT event_id, CAST(FLOOR(value / 0.25 + 0.5) AS BIGINT) AS ticks, ROUND(FLOOR(value / 0.25 + 0.5) * 0.25, 8) AS price, CAST(round_even(value / 0.25, 0) AS BIGINT) AS even FROM events")
def tick_rounding(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.to_ticks(F.col("value"), 0.25).alias("ticks"), S.to_price(S.to_ticks(F.col("value"), 0.25), 0.25).alias("price"), F.rint(F.col("value") / 0.25).cast("long").alias("even"))


@query("i05_book_scalars", "WITH q AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS pk, l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b, l_quantity AS av, l_quantity * (1 + l_tax) AS bv FROM lineitem) SELECT k, n, pk, ROUND((a + b) / 2, 6) AS mid, ROUND(CASE WHEN bv + av > 1e-9 THEN (bv - av) / (bv + av) ELSE 0.0 END, 6) AS imb, ROUND((a - b) / ((a + b) / 2) * 1e4, 6) AS spread_bp, CASE WHEN ABS(m) < 1e-6 THEN 0.0 ELSE ROUND(m, 6) END AS micro_bp FROM (SELECT *, ((a * bv + b * av) / GREATEST(av + bv, 1e-9) - (a + b) / 2) / ((a + b) / 2) * 1e4 AS m FROM q)")
def book_scalars(spark, d):
    li = table(spark, d, "lineitem")
    a, b, av, bv = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_quantity"), F.col("l_quantity") * (1 + F.col("l_tax"))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"), R6(S.mid(b, a)).alias("mid"), R6(S.imbalance(bv, av)).alias("imb"), R6(S.spread_bp(b, a)).alias("spread_bp"), F.when(F.abs(S.micro_bp(b, bv, a, av)) < 1e-6, 0.0).otherwise(R6(S.micro_bp(b, bv, a, av))).alias("micro_bp"))


@query("i08_slope", "WITH r AS (SELECT l_orderkey AS k, l_quantity AS q, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_quantity, l_partkey) AS i FROM lineitem) SELECT k, ROUND(SUM(CASE WHEN i <= 10 THEN q * i ELSE 0 END) / GREATEST(SUM(CASE WHEN i <= 10 THEN q ELSE 0 END), 1e-9), 6) AS slope, ROUND(SUM(CASE WHEN i <= 5 THEN q ELSE 0 END), 6) AS depth5 FROM r GROUP BY 1")
def slope(spark, d):
    q = F.transform("asks", lambda x: x["q"])
    return level_arrays(spark, d).select("k", R6(S.depth_slope(q)).alias("slope"), R6(S.array_sum(F.slice(q, 1, 5))).alias("depth5"))


@query("i11_window_normalisation", "SELECT l_orderkey, l_linenumber, l_partkey, ROUND((l_extendedprice - 50000.0) / 50000.0 * 1e4, 6) AS bp, ROUND((LN(1 + l_quantity) - 3.0) / 0.8, 6) AS z FROM lineitem")
def window_normalisation(spark, d):
    li = table(spark, d, "lineitem")
    out = S.normalised_window(F.array("l_extendedprice"), F.array("l_quantity"), F.lit(50_000.0), F.lit(3.0), F.lit(0.8))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", out.alias("w")).select("l_orderkey", "l_linenumber", "l_partkey", R6(F.col("w.price_bp")[0]).alias("bp"), R6(F.col("w.volume_z")[0]).alias("z"))


@query("i20_recode", "SELECT CAST(3 - label AS INT) AS y, COUNT(*) AS n FROM (SELECT CAST(event_id % 3 + 1 AS INT) AS label FROM events) GROUP BY 1")
def recode(spark, d):
    return table(spark, d, "events").select((F.col("event_id") % 3 + 1).cast("int").alias("label")).groupBy(S.recode_three(F.col("label")).alias("y")).agg(F.count("*").alias("n"))


@query("i21_latency", TICKS + ", l AS (SELECT symbol, (event_ms * 1000000 + k * 1500000) / 1e6 - event_ms AS ms FROM ev) SELECT symbol, ROUND(median(ms), 4) AS p50, median(ms) < 0 AS skewed FROM l GROUP BY 1")
def latency(spark, d):
    ms = S.transport_ms(F.col("event_ms") * 1_000_000 + F.col("k") * 1_500_000, F.col("event_ms"))
    return ticks(spark, d).withColumn("ms", ms).groupBy("symbol").agg(F.round(F.median("ms"), 4).alias("p50"), (F.median("ms") < 0).alias("skewed"))


@query("i22_periods", TICKS + " SELECT event_ms // 1000 - (event_ms // 1000) % 3600 AS period_s, COUNT(*) AS n FROM ev GROUP BY 1")
def periods(spark, d):
    s = F.floor(F.col("event_ms") / 1000)
    return ticks(spark, d).groupBy(S.period(s, 3600).alias("period_s")).agg(F.count("*").alias("n"))


@query("i24_path_parts", TICKS + " SELECT strftime(ts, '%Y-%m-%d') AS date, CAST(strftime(ts, '%H') AS INT) AS hour, COUNT(*) AS n FROM ev GROUP BY ALL")
def path_parts(spark, d):
    path = F.date_format(F.col("ts").cast("timestamp"), "'depth/date='yyyy-MM-dd'/hour='HH")
    return ticks(spark, d).groupBy(F.regexp_extract(path, r"date=([0-9-]+)", 1).alias("date"), F.regexp_extract(path, r"hour=(\d+)", 1).cast("int").alias("hour")).agg(F.count("*").alias("n"))


@query("i25_json", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COUNT(*) AS n FROM events GROUP BY 1")
def json_fields(spark, d):
    return table(spark, d, "events").where(F.try_parse_json("props").isNotNull()).groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("i26_latency_frames", "SELECT event_id, CAST(round_even(value / 100.0, 0) AS INT) AS frames FROM events")
def latency_frames(spark, d):
    return table(spark, d, "events").select("event_id", S.latency_frames(F.col("value")).alias("frames"))


# -- checks --------------------------------------------------------------------------------------


@query("q02_monitor_status", TICKS + ", u AS (SELECT user_id, MAX(event_ms) AS last, SUM(CASE WHEN k < 2 THEN 1 ELSE 0 END) AS missing, COUNT(*) FILTER (k > 90) AS written FROM ev GROUP BY 1), m AS (SELECT MAX(last) AS now FROM u) SELECT user_id, CASE WHEN (now - last) / 1000.0 > 86400 THEN 'NO HEARTBEAT' WHEN missing > 3 THEN 'DEGRADED' WHEN written <= 0 THEN 'NOT WRITING' ELSE 'LIVE' END AS status FROM u, m")
def monitor_status(spark, d):
    u = ticks(spark, d).groupBy("user_id").agg(F.max("event_ms").alias("last"), F.count_if(F.col("k") < 2).alias("missing"), F.count_if(F.col("k") > 90).alias("written"))
    now = u.agg(F.max("last").alias("now"))
    age = (F.col("now") - F.col("last")) / 1000.0 / 480  # a day of silence counts as 180 s
    return u.crossJoin(F.broadcast(now)).select("user_id", quality.monitor_status(age, F.col("missing") <= 3, F.col("written")).alias("status"))


@query("q05_thin_hours", TICKS + f", h AS (SELECT {HOUR} AS hour, COUNT(*) AS n_depth FROM ev GROUP BY 1) SELECT hour AS hour_ms, n_depth FROM h WHERE hour > (SELECT MIN(hour) FROM h) AND hour < (SELECT MAX(hour) FROM h) AND n_depth < 12")
def thin_hours(spark, d):
    h = ticks(spark, d).groupBy(F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour")).agg(F.count("*").alias("n_depth"))
    return quality.thin_hours(h, least=12).select(F.col("hour").alias("hour_ms"), "n_depth")


@query("q07_projection", "SELECT event_type AS symbol, ROUND(SUM(strlen(props)) / 1e6 / COUNT(DISTINCT date_trunc('hour', ts)) * 24, 6) AS mb_day FROM events GROUP BY 1")
def projection(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol")).agg(F.sum(F.octet_length("props")).alias("bytes"), F.countDistinct(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hours"))
    return quality.projection(e, "bytes", "hours").select("symbol", R6(F.col("mb_day")).alias("mb_day"))


@query("q08_verdict", TICKS + ", c AS (SELECT user_id, COUNT(*) FILTER (k < 5) AS n FROM ev GROUP BY 1), s AS (SELECT CASE WHEN n > 8 THEN 'BAD' WHEN n > 4 THEN 'WARN' ELSE 'OK' END AS status FROM c) SELECT status, COUNT(*) AS n, status = 'BAD' AS fails FROM s GROUP BY 1")
def verdict(spark, d):
    c = ticks(spark, d).groupBy("user_id").agg(F.count_if(F.col("k") < 5).alias("n"))
    return quality.verdict(c.select(quality.status(F.col("n") > 8, F.col("n") > 4).alias("status")))


@query("q11_price_change", TICKS + ", t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq DESC) AS r FROM ev) SELECT symbol, ROUND((arg_max(mid, seq) / arg_min(mid, seq) - 1) * 100, 6) AS change_pct FROM t WHERE r <= 60 GROUP BY 1")
def price_change(spark, d):
    rows = quality.tail(ticks(spark, d), ["symbol"], ["seq"], 60)
    return rows.groupBy("symbol").agg(R6((F.max_by("mid", "seq") / F.min_by("mid", "seq") - 1) * 100).alias("change_pct"))


@query("q13_crossed_quotes", "SELECT l_orderkey, bool_or(l_tax <= l_discount) AS crossed FROM lineitem GROUP BY 1")
def crossed_quotes(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_tax") <= F.col("l_discount")).alias("crossed"))


@query("q14_with_control", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def with_control(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey").join(li.where("l_returnflag = 'R'").select("l_orderkey"), "l_orderkey", "left_semi")


@query("q15_offered_and_kept", FRAMES + " SELECT symbol, COUNT(*) AS offered, COUNT(*) FILTER (pos >= 25 AND pos < len - 20) AS kept, ROUND(1 - COUNT(*) FILTER (pos >= 25 AND pos < len - 20) / COUNT(*), 6) AS trimmed FROM fp GROUP BY 1")
def offered_and_kept(spark, d):
    keep = (F.col("pos") >= 25) & (F.col("pos") < F.col("len") - 20)
    return W.positions(frames(spark, d)).groupBy("symbol").agg(F.count("*").alias("offered"), F.count_if(keep).alias("kept"), R6(1 - F.count_if(keep) / F.count("*")).alias("trimmed"))


@query("k05_manifest", FRAMES + " SELECT symbol, segment_id, MIN(seq) AS start, MAX(seq) AS stop, COUNT(*) AS n FROM fr GROUP BY ALL")
def manifest(spark, d):
    return sinks.intervals(frames(spark, d))
