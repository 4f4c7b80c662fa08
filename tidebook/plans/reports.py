"""Registered aggregates: archive reports, percentiles, confusion tables, costs, coverage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import book, cost, folds, gaps, metrics, ml, quality, tensors
from tidebook.operators import frames as W
from tidebook.plans.registry import FRAMES, TICKS, forward_sql, frames, query, table, ticks
from tidebook.plans.windows import CHAIN, chain
from tidebook.sources import sinks

R6 = lambda c: F.round(c, 6)
TYPES = ["click", "error", "purchase", "signup", "view"]
HOUR = "CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT)"


def hour_ms(c="ts"):
    return F.unix_millis(F.date_trunc("hour", F.col(c).cast("timestamp")))


@query("a01_hourly_counts", TICKS + f" SELECT {HOUR} AS hour_ms, " + ", ".join(f"COUNT(*) FILTER (symbol = '{t}') AS {t}" for t in TYPES) + " FROM ev GROUP BY 1")
def hourly_counts(spark, d):
    rows = ticks(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    return quality.hourly(rows, "at", "symbol", TYPES).select(F.unix_millis("hour").alias("hour_ms"), *(F.col(t).cast("long").alias(t) for t in TYPES))


@query("a02_bytes_by_stream", "SELECT event_type AS symbol, CAST(SUM(strlen(props)) AS BIGINT) AS bytes, COUNT(*) AS n FROM events GROUP BY 1")
def bytes_by_stream(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("symbol")).agg(F.sum(F.octet_length("props").cast("long")).alias("bytes"), F.count("*").alias("n"))


GAPS_SQL = CHAIN + """, g AS (SELECT user_id, ABS(prev_id - expected) AS size, CASE WHEN prev_id > expected THEN 1 ELSE 0 END AS miss FROM ch WHERE expected IS NOT NULL AND prev_id <> expected),
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY size) AS r, COUNT(*) OVER (PARTITION BY user_id) AS n FROM g),
a AS (SELECT user_id, COUNT(*) AS gaps, CAST(SUM(miss) AS BIGINT) AS missing, CAST(SUM(size) AS BIGINT) AS ids_lost, MAX(CASE WHEN r = n // 2 + 1 THEN size END) AS median_delta, MAX(size) AS max_delta FROM rk GROUP BY 1),
dp AS (SELECT user_id, COUNT(*) AS n_depth FROM kept GROUP BY 1)
"""


@query("a03_gap_report", GAPS_SQL + """SELECT user_id, n_depth, COALESCE(gaps, 0) AS gaps, COALESCE(missing, 0) AS missing, COALESCE(ids_lost, 0) AS ids_lost, median_delta, max_delta,
 ROUND(COALESCE(ids_lost, 0) / (n_depth + COALESCE(ids_lost, 0)), 6) AS loss_rate FROM dp LEFT JOIN a USING (user_id)""")
def gap_report(spark, d):
    rows = chain(spark, d)
    report = gaps.gap_report(gaps.sequence_gaps(rows, ["user_id"]), rows.groupBy("user_id").agg(F.count("*").alias("n_depth")), ["user_id"])
    return report.withColumn("loss_rate", R6(F.col("loss_rate"))).select("user_id", "n_depth", "gaps", "missing", "ids_lost", "median_delta", "max_delta", "loss_rate")


@query("a04_worst_hour", TICKS + f", h AS (SELECT symbol, {HOUR} AS hour_ms, CAST(SUM(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM ev GROUP BY ALL) SELECT symbol, hour_ms, gaps FROM h QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY gaps DESC, hour_ms) = 1")
def worst_hour(spark, d):
    h = ticks(spark, d).groupBy("symbol", hour_ms().alias("hour_ms")).agg(F.count_if(F.col("k") == 0).alias("gaps"))
    best = h.groupBy("symbol").agg(F.max(F.struct("gaps", (-F.col("hour_ms")).alias("h"))).alias("b"))
    return best.select("symbol", (-F.col("b.h")).alias("hour_ms"), F.col("b.gaps").alias("gaps"))


@query("a05_gap_rate_status", TICKS + """, h AS (SELECT symbol, COUNT(DISTINCT date_trunc('hour', ts)) AS hours, CAST(SUM(CASE WHEN k < 10 THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM ev GROUP BY 1)
SELECT symbol, hours, gaps, ROUND(gaps / hours, 6) AS rate, CASE WHEN gaps / hours < 5 THEN 'OK' WHEN gaps / hours < 40 THEN 'WARN' ELSE 'BAD' END AS status FROM h""")
def gap_rate_status(spark, d):
    h = ticks(spark, d).groupBy("symbol").agg(F.countDistinct(hour_ms()).alias("hours"), F.count_if(F.col("k") < 10).alias("gaps"))
    rate = F.col("gaps") / F.col("hours")
    return h.select("symbol", "hours", "gaps", R6(rate).alias("rate"), gaps.gap_status(rate).alias("status"))


@query("a06_rank_percentiles", TICKS + """, r AS (SELECT symbol, mid, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY mid) - 1 AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM ev)
SELECT symbol, MAX(CASE WHEN i = FLOOR(n * 0.5) THEN mid END) AS p50, MAX(CASE WHEN i = FLOOR(n * CAST(0.9 AS DOUBLE)) THEN mid END) AS p90, MAX(CASE WHEN i = FLOOR(n * CAST(0.99 AS DOUBLE)) THEN mid END) AS p99 FROM r GROUP BY 1""")
def rank_percentiles(spark, d):
    return quality.by_rank(ticks(spark, d), ["symbol"], "mid", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("a07_linear_percentiles", TICKS + " SELECT symbol, ROUND(quantile_cont(mid, 0.25), 6) AS p25, ROUND(median(mid), 6) AS p50, ROUND(quantile_cont(mid, 0.999), 6) AS p999 FROM ev GROUP BY 1")
def linear_percentiles(spark, d):
    return ticks(spark, d).groupBy("symbol").agg(R6(F.percentile("mid", 0.25)).alias("p25"), R6(F.median("mid")).alias("p50"), R6(F.percentile("mid", 0.999)).alias("p999"))


@query("a08_removal_share", TICKS + ", f AS (SELECT symbol, k FROM ev WHERE seq < 3000) SELECT symbol, COUNT(*) AS n, ROUND(SUM(CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) / COUNT(*), 6) AS removed FROM f GROUP BY 1")
def removal_share(spark, d):
    """Level changes of the first 3000 events that are deletes (quantity k modulo 8 is 0)."""
    rows = ticks(spark, d).where("seq < 3000").select("symbol", F.explode(F.array(F.struct((F.col("k") % 8).alias("q")))).alias("x"))
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), R6(F.count_if(F.col("x.q") == 0) / F.count("*")).alias("removed"))


FOLDS_SQL = """, sp AS (SELECT MIN(seq) AS lo, MAX(seq) AS hi FROM fp WHERE pos >= 4 AND pos <= len - 11),
fo AS (SELECT f.f AS fold, CAST(FLOOR(lo + (hi + 1 - lo) / 6.0 * (f.f + 1)) AS BIGINT) AS t0, CASE WHEN f.f = 4 THEN hi + 1 ELSE CAST(FLOOR(lo + (hi + 1 - lo) / 6.0 * (f.f + 2)) AS BIGINT) END AS t1 FROM sp, (SELECT UNNEST([0,1,2,3,4]) AS f) f),
ro AS (SELECT fo.fold, CASE WHEN seq >= t0 AND seq < t1 THEN 'test' WHEN seq + 10 < t0 - 10 THEN 'train' END AS role, fp.* FROM fp, fo WHERE pos >= 4 AND pos <= len - 11),
rl AS (SELECT * FROM ro WHERE role IS NOT NULL)
"""


def fold_rows(spark, d):
    ends = W.valid_ends(frames(spark, d), 5, 10)
    return folds.make_folds(ends, 5, 10, position="seq")


@query("f01_walk_forward", FRAMES + FOLDS_SQL + "SELECT fold, role, COUNT(*) AS n, MIN(seq) AS first_seq, MAX(seq) AS last_seq FROM rl GROUP BY ALL")
def walk_forward(spark, d):
    return fold_rows(spark, d).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("f02_purge", FRAMES + FOLDS_SQL + "SELECT tr.fold, tr.m AS last_train, te.m AS first_test, te.m - tr.m AS gap FROM (SELECT fold, MAX(seq) AS m FROM rl WHERE role = 'train' GROUP BY 1) tr JOIN (SELECT fold, MIN(seq) AS m FROM rl WHERE role = 'test' GROUP BY 1) te USING (fold)")
def purge(spark, d):
    rows = fold_rows(spark, d).groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col("seq"))).alias("last_train"), F.min(F.when(F.col("role") == "test", F.col("seq"))).alias("first_test"))
    return rows.withColumn("gap", F.col("first_test") - F.col("last_train"))


@query("f03_embargo", FRAMES + FOLDS_SQL + "SELECT fold, COUNT(*) AS n_train, CAST(0 AS BIGINT) AS n_embargoed FROM rl WHERE role = 'train' GROUP BY 1")
def embargo(spark, d):
    """On a forward walk no training row follows the test block, so the embargo takes nothing."""
    ends = W.valid_ends(frames(spark, d), 5, 10)
    plain, kept = (folds.make_folds(ends, 5, 10, embargo=e, position="seq").where("role = 'train'").groupBy("fold").agg(F.count("*").alias(n)) for e, n in ((0, "n_train"), (500, "n_kept")))
    return plain.join(kept, "fold").select("fold", "n_train", (F.col("n_train") - F.col("n_kept")).alias("n_embargoed"))


@query("f04_tail_split", TICKS + """, t AS (SELECT symbol, seq, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq) - 1 AS i, COUNT(*) OVER (PARTITION BY symbol) AS n FROM ev),
r AS (SELECT symbol, seq, CASE WHEN i >= n - FLOOR(n * CAST(0.15 AS DOUBLE)) THEN 'val' WHEN i < n - FLOOR(n * CAST(0.15 AS DOUBLE)) - 100 THEN 'fit' END AS role FROM t)
SELECT symbol, role, COUNT(*) AS n, MIN(seq) AS first_seq, MAX(seq) AS last_seq FROM r WHERE role IS NOT NULL GROUP BY ALL""")
def tail_split(spark, d):
    rows = folds.tail_split(ticks(spark, d), 0.15, 100, ["symbol"])
    return rows.groupBy("symbol", "role").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("a09_fold_alpha", FRAMES + FOLDS_SQL + "SELECT fold, ROUND(median((k + 1) / 100.0 / 2 / mid * 1e4) * 1.5, 6) AS alpha FROM rl WHERE role = 'train' GROUP BY 1")
def fold_alpha(spark, d):
    rows = fold_rows(spark, d).withColumn("spread", (F.col("k") + 1) / 100.0)
    return folds.fold_alpha(rows, 1.5).select("fold", R6(F.col("alpha")).alias("alpha"))


@query("a10_fold_stats", FRAMES + FOLDS_SQL + "SELECT fold, ROUND(AVG(mid), 6) AS mean_mid, ROUND(STDDEV_POP(mid), 6) AS sd_mid, ROUND(AVG(k), 6) AS mean_k, ROUND(STDDEV_POP(k), 6) AS sd_k FROM rl WHERE role = 'train' GROUP BY 1")
def fold_stats(spark, d):
    out = folds.fold_stats(fold_rows(spark, d), ["mid", "k"])
    return out.select("fold", *(R6(F.col(c)).alias(c) for c in ("mean_mid", "sd_mid", "mean_k", "sd_k")))


@query("i18_z_scores", FRAMES + FOLDS_SQL + """, st AS (SELECT fold, AVG(mid) AS m, STDDEV_POP(mid) AS s FROM rl WHERE role = 'train' GROUP BY 1)
SELECT fold, seq, ROUND((mid - m) / CASE WHEN s <= 1e-9 THEN 1.0 ELSE s END, 6) AS z FROM rl JOIN st USING (fold) WHERE role = 'test'""")
def z_scores(spark, d):
    rows = folds.standardised(fold_rows(spark, d).select("fold", "role", "seq", "mid"), ["mid"])
    return rows.where("role = 'test'").select("fold", "seq", R6(F.col("mid")).alias("z"))


@query("a11_volume_stats", "SELECT ROUND(AVG(LN(1 + l_quantity)), 6) AS mean, ROUND(STDDEV_POP(LN(1 + l_quantity)), 6) AS sd FROM lineitem")
def volume_stats(spark, d):
    """Lines as volumes of their orders' windows, all of them."""
    stats = folds.volume_stats(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")
    return stats.select(R6(F.col("mean")).alias("mean"), R6(F.col("sd")).alias("sd"))


@query("f08_volume_sample", "SELECT ROUND(AVG(LN(1 + l_quantity)), 6) AS mean, ROUND(STDDEV_POP(LN(1 + l_quantity)), 6) AS sd FROM lineitem WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 < 250000")
def volume_sample(spark, d):
    """The same over a quarter of the windows, drawn by hash."""
    stats = folds.volume_stats(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", 0.25)
    return stats.select(R6(F.col("mean")).alias("mean"), R6(F.col("sd")).alias("sd"))


PRED = "SELECT o_orderkey AS id, CAST(o_orderkey % 5 AS INT) AS fold, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 250000 THEN 1 ELSE 2 END AS y, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS p FROM orders"
SCORES = f"""WITH pr AS ({PRED}), g AS (SELECT f.fold, y.y, p.p FROM (SELECT DISTINCT fold FROM pr) f, (SELECT UNNEST([0,1,2]) AS y) y, (SELECT UNNEST([0,1,2]) AS p) p),
cm AS (SELECT g.fold, g.y, g.p, COUNT(pr.id) AS n FROM g LEFT JOIN pr ON pr.fold = g.fold AND pr.y = g.y AND pr.p = g.p GROUP BY ALL),
cl AS (SELECT c.fold, l.label, CAST(SUM(CASE WHEN c.y = l.label THEN n ELSE 0 END) AS BIGINT) AS support, CAST(SUM(CASE WHEN c.p = l.label THEN n ELSE 0 END) AS BIGINT) AS predicted, CAST(SUM(CASE WHEN c.y = l.label AND c.p = l.label THEN n ELSE 0 END) AS BIGINT) AS hit
 FROM cm c, (SELECT UNNEST([0,1,2]) AS label) l GROUP BY ALL),
pr2 AS (SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0 END AS "precision", CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall FROM cl),
sc AS (SELECT *, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0.0 END AS f1 FROM pr2)
"""


def predictions(spark, d):
    """Orders as predictions: classes of the price against a rule on the status."""
    o = table(spark, d, "orders")
    y = F.when(F.col("o_totalprice") < 100_000, 0).when(F.col("o_totalprice") < 250_000, 1).otherwise(2)
    p = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), y.alias("y"), p.alias("p"))


@query("a12_confusion", SCORES + "SELECT fold, y, p, n FROM cm")
def confusion(spark, d):
    return metrics.confusion(predictions(spark, d), keys=["fold"])


@query("a13_class_scores", SCORES + """SELECT fold, label, support, predicted, hit, ROUND("precision", 6) AS "precision", ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1 FROM sc""")
def class_scores(spark, d):
    out = metrics.class_scores(metrics.confusion(predictions(spark, d), keys=["fold"]), ["fold"])
    return out.select("fold", "label", "support", "predicted", "hit", *(R6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


SUMMARY = SCORES + ", sm AS (SELECT fold, CAST(SUM(support) AS BIGINT) AS n, SUM(hit) / SUM(support) AS accuracy, MAX(support) / SUM(support) AS majority, SUM(f1) / 3 AS macro_f1, SUM(f1 * support) / SUM(support) AS weighted_f1 FROM sc GROUP BY 1)"


def fold_summary(spark, d):
    return metrics.summary(metrics.class_scores(metrics.confusion(predictions(spark, d), keys=["fold"]), ["fold"]), ["fold"])


@query("a14_weighted_f1", SUMMARY + " SELECT fold, n, ROUND(accuracy, 6) AS accuracy, ROUND(majority, 6) AS majority, ROUND(macro_f1, 6) AS macro_f1, ROUND(weighted_f1, 6) AS weighted_f1 FROM sm")
def weighted_f1(spark, d):
    return fold_summary(spark, d).select("fold", "n", *(R6(F.col(c)).alias(c) for c in ("accuracy", "majority", "macro_f1", "weighted_f1")))


@query("a15_across_folds", SUMMARY + " SELECT ROUND(AVG(macro_f1), 6) AS mean_macro_f1, ROUND(STDDEV_POP(macro_f1), 6) AS sd_macro_f1, ROUND(AVG(accuracy), 6) AS mean_accuracy, ROUND(STDDEV_POP(accuracy), 6) AS sd_accuracy FROM sm")
def across_folds(spark, d):
    out = metrics.across_folds(fold_summary(spark, d), ["macro_f1", "accuracy"])
    return out.select(*(R6(F.col(c)).alias(c) for c in ("mean_macro_f1", "sd_macro_f1", "mean_accuracy", "sd_accuracy")))


EDGE = "(SELECT *, CASE WHEN k < 30 THEN 0 WHEN k < 60 THEN 1 ELSE 2 END AS p FROM fw WHERE bp IS NOT NULL)"
EDGES = "ed AS (SELECT symbol, seq, p, bp, CASE WHEN p = 2 THEN bp WHEN p = 0 THEN -bp END AS edge FROM " + EDGE + ")"


def predicted_moves(spark, d, k=10, latency=0):
    p = F.when(F.col("k") < 30, 0).when(F.col("k") < 60, 1).otherwise(2)
    return frames(spark, d).withColumn("bp", W.forward_bp(F.col("mid"), k, latency)).where("bp is not null").withColumn("p", p)


ES = forward_sql(10) + ", " + EDGES + ", es AS (SELECT symbol, COUNT(*) AS n_rows, COUNT(edge) AS trades, AVG(edge) AS mean, STDDEV_POP(edge) AS sd FROM ed GROUP BY 1)"


@query("a16_edge_summary", ES + " SELECT symbol, n_rows, trades, ROUND(trades / n_rows, 6) AS trade_rate, ROUND(mean, 4) AS mean, ROUND(sd, 4) AS sd, ROUND(mean - 1.96 * sd / SQRT(trades), 4) AS lo, ROUND(mean + 1.96 * sd / SQRT(trades), 4) AS hi FROM es")
def edge_summary(spark, d):
    out = cost.edge_summary(predicted_moves(spark, d), ["symbol"])
    return out.select("symbol", "n_rows", "trades", R6(F.col("trade_rate")).alias("trade_rate"), *(F.round(c, 4).alias(c) for c in ("mean", "sd", "lo", "hi")))


@query("p14_trades_only", forward_sql(10) + ", " + EDGES + " SELECT symbol, seq, p, ROUND(edge, 6) AS edge FROM ed WHERE p <> 1")
def trades_only(spark, d):
    return cost.gross_edges(predicted_moves(spark, d)).select("symbol", "seq", "p", R6(F.col("edge")).alias("edge"))


@query("i16_net_edges", ES + " SELECT symbol, CAST(c.cost AS DOUBLE) AS cost, ROUND(mean - c.cost, 4) AS net FROM es, (SELECT UNNEST([5.0, 10.0, 15.0]) AS cost) c")
def net_edges(spark, d):
    out = cost.net_edges(cost.edge_summary(predicted_moves(spark, d), ["symbol"]), [5.0, 10.0, 15.0])
    return out.select("symbol", "cost", F.round("net", 4).alias("net"))


LATENCIES = (0, 2, 5)
LAT_SQL = "WITH " + ", ".join(f"l{n} AS ({forward_sql(10, n)}, {EDGES} SELECT CAST({n * 100} AS DOUBLE) AS ms, symbol, AVG(edge) AS edge, COUNT(edge) AS trades FROM ed GROUP BY 2)" for n in LATENCIES) + ", cv AS (" + " UNION ALL ".join(f"SELECT * FROM l{n}" for n in LATENCIES) + ")"


def latency_curve(spark, d):
    out = None
    for n in LATENCIES:
        mine = cost.edge_summary(predicted_moves(spark, d, 10, n), ["symbol"]).select(F.lit(float(n * 100)).alias("ms"), "symbol", F.col("mean").alias("edge"), "trades")
        out = mine if out is None else out.unionByName(mine)
    return out


@query("i14_latency_sweep", LAT_SQL + " SELECT ms, symbol, ROUND(edge, 4) AS edge, trades FROM cv")
def latency_sweep(spark, d):
    return latency_curve(spark, d).select("ms", "symbol", F.round("edge", 4).alias("edge"), "trades")


@query("i17_edge_at_latency", LAT_SQL + """ SELECT a.symbol, ROUND(a.edge + (b.edge - a.edge) * (325 - 200) / (500.0 - 200), 4) AS edge FROM (SELECT * FROM cv WHERE ms = 200) a JOIN (SELECT * FROM cv WHERE ms = 500) b USING (symbol)""")
def edge_at_latency(spark, d):
    return cost.at_latency(latency_curve(spark, d), 325, ["symbol"]).select("symbol", F.round("edge", 4).alias("edge"))


@query("a18_class_mix", forward_sql(10) + ", lb AS (SELECT symbol, CASE WHEN bp > 800 THEN 2 WHEN bp < -800 THEN 0 ELSE 1 END AS y FROM fw WHERE bp IS NOT NULL) SELECT symbol, " + ", ".join(f"ROUND(AVG(CASE WHEN y = {c} THEN 1.0 ELSE 0.0 END), 6) AS share_{c}" for c in range(3)) + " FROM lb GROUP BY 1")
def class_mix(spark, d):
    y = S.label_from_bp(F.col("bp"), 800.0)
    return predicted_moves(spark, d).withColumn("y", y).groupBy("symbol").agg(*(R6(F.avg((F.col("y") == c).cast("double"))).alias(f"share_{c}") for c in range(3)))


@query("a19_observed_tick", "WITH u AS (SELECT DISTINCT l_returnflag AS symbol, CAST(ROUND(l_extendedprice * 100) AS BIGINT) * 50 AS u FROM lineitem) SELECT symbol, list_reduce(list(u), lambda x, y: gcd(x, y)) / 100.0 AS tick, COUNT(*) AS n FROM u GROUP BY 1")
def observed_tick(spark, d):
    """Greatest common divisor of the prices in fifties of cents."""
    units = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), (F.round(F.col("l_extendedprice") * 100).cast("long") * 50).alias("u")).distinct()
    return book.gcd_by(units, "symbol", "u").select("symbol", (F.col("g") / 100.0).alias("tick"), "n")


@query("a20_summary_facts", TICKS + " SELECT symbol, arg_min(mid, seq) AS first, arg_max(mid, seq) AS last, MIN(mid) AS low, MAX(mid) AS high, ROUND(median(mid), 6) AS med, ROUND((arg_max(mid, seq) / arg_min(mid, seq) - 1) * 100, 6) AS change_pct FROM ev GROUP BY 1")
def summary_facts(spark, d):
    a, b = F.min_by("mid", "seq"), F.max_by("mid", "seq")
    return ticks(spark, d).groupBy("symbol").agg(a.alias("first"), b.alias("last"), F.min("mid").alias("low"), F.max("mid").alias("high"), R6(F.median("mid")).alias("med"), R6((b / a - 1) * 100).alias("change_pct"))


@query("a21_window_counts", FRAMES + ", n AS (SELECT symbol, segment_id, COUNT(*) AS n FROM fr GROUP BY ALL) SELECT symbol, COUNT(*) AS segments, MAX(n) AS longest, CAST(SUM(GREATEST(0, n - 20 - 10 + 1)) AS BIGINT) AS windows FROM n GROUP BY 1")
def window_counts(spark, d):
    n = frames(spark, d).groupBy("symbol", "segment_id").agg(F.count("*").alias("n"))
    return n.groupBy("symbol").agg(F.count("*").alias("segments"), F.max("n").alias("longest"), F.sum(F.greatest(F.lit(0).cast("long"), F.col("n") - 29)).alias("windows"))


SPINE = TICKS + """, h AS (SELECT date_trunc('hour', ts) AS hour, COUNT(*) AS n, CAST(SUM(k) AS BIGINT) AS bytes FROM ev WHERE k >= 60 GROUP BY 1),
spn AS (SELECT UNNEST(generate_series((SELECT MIN(hour) FROM h), (SELECT MAX(hour) FROM h), INTERVAL 1 HOUR)) AS hour),
cv AS (SELECT spn.hour, COALESCE(n, 0) AS n, COALESCE(bytes, 0) AS bytes FROM spn LEFT JOIN h USING (hour))"""


def covered_hours(spark, d):
    h = ticks(spark, d).where("k >= 60").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"), F.sum("k").alias("bytes"))
    return quality.on_spine(h, ["n", "bytes"])


@query("j07_hour_spine", SPINE + " SELECT CAST(epoch_ms(hour) AS BIGINT) AS hour_ms, n, bytes FROM cv")
def hour_spine(spark, d):
    return covered_hours(spark, d).select(F.unix_millis("hour").alias("hour_ms"), "n", "bytes")


@query("a22_coverage", SPINE + " SELECT COUNT(*) AS hours, COUNT(*) FILTER (n > 0) AS covered, ROUND(COUNT(*) FILTER (n > 0) / COUNT(*), 6) AS share, ROUND(median(CASE WHEN n > 0 THEN bytes END), 6) AS median_bytes FROM cv")
def coverage(spark, d):
    hit = F.col("n") > 0
    return covered_hours(spark, d).agg(F.count("*").alias("hours"), F.count_if(hit).alias("covered"), R6(F.count_if(hit) / F.count("*")).alias("share"), R6(F.median(F.when(hit, F.col("bytes")))).alias("median_bytes"))


@query("a23_depth_heat", TICKS + """, c AS (SELECT symbol, seq // 500 AS col, CAST(round_even(mid / 5.0, 0) AS BIGINT) AS "row", k FROM ev), s AS (SELECT CEIL(quantile_cont(ABS("row"), 0.99)) AS span FROM c)
SELECT symbol, col, "row", CAST(SUM(k) AS BIGINT) AS qty FROM c, s WHERE ABS("row") <= span GROUP BY ALL""")
def depth_heat(spark, d):
    c = ticks(spark, d).select("symbol", F.floor(F.col("seq") / 500).alias("col"), F.rint(F.col("mid") / 5.0).cast("long").alias("row"), "k")
    span = c.agg(F.ceil(F.percentile(F.abs("row"), 0.99)).alias("span"))
    return c.crossJoin(F.broadcast(span)).where(F.abs("row") <= F.col("span")).groupBy("symbol", "col", "row").agg(F.sum("k").alias("qty"))


@query("a24_rank_correlation", """WITH u AS (SELECT user_id, AVG(value) AS x, COUNT(*) AS y FROM events GROUP BY 1), r AS (SELECT ROW_NUMBER() OVER (ORDER BY ROUND(x, 6), user_id) AS rx, ROW_NUMBER() OVER (ORDER BY y, user_id) AS ry FROM u)
SELECT ROUND(corr(rx, ry), 6) AS rho FROM r""")
def rank_correlation(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(R6(F.avg("value")).alias("x"), F.count("*").alias("y"))
    return metrics.rank_correlation(u, "x", "y", "user_id").select(R6(F.col("rho")).alias("rho"))


@query("a25_trial_counts", "SELECT COUNT(*) FILTER (o_orderstatus = 'O') AS started, COUNT(*) FILTER (o_orderstatus = 'F') AS finished FROM orders")
def trial_counts(spark, d):
    """Orders as records of a ledger."""
    state = F.when(F.col("o_orderstatus") == "O", "started").when(F.col("o_orderstatus") == "F", "finished").otherwise("other")
    return sinks.trial_counts(table(spark, d, "orders").select(F.to_json(F.struct(F.col("o_orderkey").alias("run"), state.alias("state"))).alias("value")))


@query("a26_integrity", TICKS + """, q AS (SELECT user_id, 100.0 * SUM(CASE WHEN k = 7 THEN 1 ELSE 0 END) / COUNT(*) AS loss, SUM(CASE WHEN k < 3 THEN 1 ELSE 0 END) / 24.0 AS gph, SUM(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS rec, SUM(CASE WHEN k = 2 THEN 1 ELSE 0 END) AS fail FROM ev GROUP BY 1)
SELECT user_id, ROUND(GREATEST(0, 100 - (LEAST(30, 2 * loss) + LEAST(30, gph / 2) + LEAST(20, rec) + LEAST(20, 5.0 * fail))), 6) AS score FROM q""")
def integrity(spark, d):
    n = lambda c: F.count_if(c)
    q = ticks(spark, d).groupBy("user_id").agg((100.0 * n(F.col("k") == 7) / F.count("*")).alias("loss"), (n(F.col("k") < 3) / 24.0).alias("gph"), n(F.col("k") == 1).alias("rec"), n(F.col("k") == 2).alias("fail"))
    return q.select("user_id", R6(quality.integrity(F.col("loss"), F.col("gph"), F.col("rec").cast("double"), F.col("fail").cast("double"))).alias("score"))


@query("a27_balance_grid", "WITH " + ", ".join(f"k{k} AS ({forward_sql(k)} SELECT {k} AS k, bp FROM fw WHERE bp IS NOT NULL)" for k in (5, 10, 20)) + """, m AS (SELECT * FROM k5 UNION ALL SELECT * FROM k10 UNION ALL SELECT * FROM k20), g AS (SELECT k, alpha, AVG(CASE WHEN bp < -alpha THEN 1.0 ELSE 0.0 END) AS dn, AVG(CASE WHEN bp > alpha THEN 1.0 ELSE 0.0 END) AS up, AVG(CASE WHEN bp <= alpha AND bp >= -alpha THEN 1.0 ELSE 0.0 END) AS flat FROM m, (SELECT UNNEST([100.0, 1000.0, 5000.0, 20000.0]) AS alpha) a GROUP BY ALL)
SELECT k, CAST(alpha AS DOUBLE) AS alpha, ROUND(dn, 6) AS share_down, ROUND(flat, 6) AS share_flat, ROUND(up, 6) AS share_up, CASE WHEN flat > 0.85 THEN 'too flat' WHEN flat < 0.10 THEN 'too moving' ELSE 'ok' END AS flag FROM g""")
def balance_grid(spark, d):
    base, moves = frames(spark, d), None
    for k in (5, 10, 20):
        mine = base.withColumn("bp", W.forward_bp(F.col("mid"), k)).where("bp is not null").select(F.lit(k).alias("k"), "bp")
        moves = mine if moves is None else moves.unionByName(mine)
    alphas = spark.createDataFrame([(a,) for a in (100.0, 1000.0, 5000.0, 20000.0)], "alpha double")
    out = metrics.balance_grid(moves, alphas)
    return out.select("k", "alpha", *(R6(F.col(c)).alias(c) for c in ("share_down", "share_flat", "share_up")), "flag")


@query("a28_unchanged_share", TICKS + ", l AS (SELECT symbol, CASE WHEN mid = LAG(mid) OVER (PARTITION BY symbol ORDER BY seq) THEN 1.0 ELSE 0.0 END AS same, LAG(mid) OVER (PARTITION BY symbol ORDER BY seq) AS b FROM ev) SELECT symbol, ROUND(AVG(same), 6) AS unchanged FROM l WHERE b IS NOT NULL GROUP BY 1")
def unchanged_share(spark, d):
    """Across segment edges, as published; the segment-local share is one partition column more."""
    rows = W.with_previous(ticks(spark, d), {"b": F.col("mid")}, ["symbol"]).where("b is not null")
    return rows.groupBy("symbol").agg(R6(F.avg((F.col("mid") == F.col("b")).cast("double"))).alias("unchanged"))


@query("a29_size_key", FRAMES + FOLDS_SQL + "SELECT CAST(round_even(SUM(n) * 6 / 5.0 / 1000, 0) AS BIGINT) AS windows_k FROM (SELECT fold, COUNT(*) AS n FROM rl WHERE role = 'test' GROUP BY 1)")
def size_key(spark, d):
    return fold_rows(spark, d).where("role = 'test'").agg(F.bround(F.count("*") * 6 / 5.0 / 1000, 0).cast("long").alias("windows_k"))


@query("a30_outcomes_by_hour", CHAIN + """, o AS (SELECT date_trunc('hour', e.ts) AS h, CASE WHEN c.expected IS NULL THEN 'unanchored' WHEN c.prev_id = c.expected THEN 'applied' ELSE 'desync' END AS outcome FROM ch c JOIN ev e ON e.seq = c.seq)
SELECT CAST(epoch_ms(h) AS BIGINT) AS hour_ms, outcome, COUNT(*) AS n FROM o GROUP BY ALL""")
def outcomes_by_hour(spark, d):
    outcome = F.when(F.col("expected").isNull(), "unanchored").when(F.col("prev_id") == F.col("expected"), "applied").otherwise("desync")
    return W.with_previous(chain(spark, d), {"expected": F.col("final_id")}, ["user_id"]).groupBy(hour_ms().alias("hour_ms"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("a31_class_weights", f"WITH pr AS ({PRED}), h AS (SELECT y FROM pr ORDER BY id LIMIT 20000), c AS (SELECT y, COUNT(*) AS n FROM h GROUP BY 1) SELECT l.label, ROUND(COALESCE((SELECT SUM(n) FROM c) / (3.0 * c.n), 1.0), 6) AS weight FROM (SELECT UNNEST([0,1,2]) AS label) l LEFT JOIN c ON c.y = l.label")
def class_weights(spark, d):
    out = folds.class_weights(predictions(spark, d).withColumnRenamed("id", "frame_id"), "y")
    return out.select("label", R6(F.col("weight")).alias("weight"))


@query("f09_block_sums", TICKS + ", b AS (SELECT symbol, seq, CASE WHEN COUNT(mid) OVER w = 20 THEN SUM(mid) OVER w END AS s FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) SELECT symbol, seq, ROUND(s, 6) AS block_sum FROM b WHERE s IS NOT NULL")
def block_sums(spark, d):
    out = cost.block_sums(ticks(spark, d).withColumn("edge", F.col("mid")), 20, ["symbol"])
    return out.where("block_sum is not null").select("symbol", "seq", R6(F.col("block_sum")).alias("block_sum"))


#: Blocks of 20 trades; the starts are the digest of seed, symbol, resample and block.
BOOTSTRAP = forward_sql(10) + ", " + EDGES + """, tr AS (SELECT symbol, edge, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq) AS pos FROM ed WHERE p <> 1),
rs AS (SELECT symbol, pos AS at, SUM(edge) OVER (PARTITION BY symbol ORDER BY pos) AS total FROM tr),
n AS (SELECT symbol, COUNT(*) AS n, AVG(edge) AS mean, LEAST(20, COUNT(*)) AS len FROM tr GROUP BY 1),
dr AS (SELECT symbol, n, r, b, CASE WHEN b < n // len THEN len ELSE n % len END AS size FROM (SELECT *, unnest(range(0, n // len + CASE WHEN n % len > 0 THEN 1 ELSE 0 END)) AS b FROM (SELECT *, unnest(range(0, 200)) AS r FROM n WHERE n > 1))),
st AS (SELECT symbol, r, n, size, CAST('0x' || substr(md5('0:' || symbol || ':' || r || ':' || b), 1, 15) AS BIGINT) % (n - size + 1) AS start FROM dr),
mn AS (SELECT st.symbol, r, SUM(hi.total - COALESCE(lo.total, 0)) / MAX(n) AS m FROM st JOIN rs hi ON hi.symbol = st.symbol AND hi.at = start + size LEFT JOIN rs lo ON lo.symbol = st.symbol AND lo.at = start GROUP BY ALL)
SELECT n.symbol, n.n, ROUND(MAX(mean), 4) AS mean, ROUND(quantile_cont(m, 0.025), 4) AS lo, ROUND(quantile_cont(m, 0.975), 4) AS hi FROM n LEFT JOIN mn USING (symbol) GROUP BY ALL"""


@query("f09_bootstrap", BOOTSTRAP)
def bootstrap(spark, d):
    """Intervals of the mean edge of each symbol's trades, by blocks of 20."""
    out = cost.bootstrap(cost.gross_edges(predicted_moves(spark, d)), ["symbol"], 20, 200)
    return out.select("symbol", "n", *(F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")))


@query("m05_windows", FRAMES + """, w AS (SELECT symbol, segment_id, mid, pos, len, SUM(mid) OVER f AS s, SUM(LN(1 + k)) OVER f AS v FROM fp WINDOW f AS (PARTITION BY symbol, segment_id ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT symbol, segment_id, COUNT(*) AS n, ROUND(SUM((s - 8 * mid) / mid * 1e4), 3) AS prices, ROUND(SUM(v), 3) AS volumes FROM w WHERE pos >= 7 AND pos <= len - 4 GROUP BY ALL""")
def tensor_windows(spark, d):
    """Windows of eight frames that end a full window with three frames after it: prices against the last mid, log volumes."""
    rows = W.positions(frames(spark, d)).withColumn("frame", F.array(F.col("mid"), F.col("k").cast("double")))
    ends = (F.col("pos") >= 7) & (F.col("pos") <= F.col("len") - 4)

    def sums(x: np.ndarray) -> dict[str, np.ndarray]:
        return {"prices": x[:, :, 0].sum(1), "volumes": x[:, :, 1].sum(1)}

    found = tensors.map_windows(rows, ends, 8, sums, "prices double, volumes double", bucket=64)
    return found.groupBy("symbol", "segment_id").agg(F.count("*").alias("n"), F.round(F.sum("prices"), 3).alias("prices"), F.round(F.sum("volumes"), 3).alias("volumes"))


@query("m01_logistic")
def logistic(spark, d):
    """Folds of a linear model on lagged returns, scored by class."""
    from tidebook.operators import ml

    base = frames(spark, d).withColumn("y", S.label_from_bp(W.forward_bp(F.col("mid"), 10), 2_000.0))
    for n in (1, 5, 10):
        base = base.withColumn(f"r{n}", W.lagged_return_bp(F.col("mid"), n))
    rows = folds.make_folds(W.valid_ends(base, 5, 10), 3, 10, position="seq").withColumn("frame_id", F.col("seq"))
    scored = ml.fit_predict(rows, ["r1", "r5", "r10"], keep=["frame_id"], max_iter=25)
    return metrics.summary(metrics.class_scores(metrics.confusion(scored, keys=["fold"]), ["fold"]), ["fold"])


@query("s05_a06_book_tail", TICKS + ", t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY seq DESC) AS r FROM ev) SELECT symbol, seq, mid FROM t WHERE r <= 25")
def book_tail(spark, d):
    return quality.tail(ticks(spark, d), ["symbol"], ["seq"], 25).select("symbol", "seq", "mid")


@query("m02_adam")
def adam_rounds(spark, d):
    """Rounds of the seeded mini-batch descent on lagged returns: loss, validation macro F1, the best round so far."""
    from tidebook.operators import adam

    base = frames(spark, d).withColumn("y", S.label_from_bp(W.forward_bp(F.col("mid"), 10), 2_000.0))
    for n in (1, 5):
        base = base.withColumn(f"r{n}", W.lagged_return_bp(F.col("mid"), n) / 10_000)
    rows = W.valid_ends(base, 5, 10).select("symbol", "seq", "y", "r1", "r5").where("y is not null")
    split = folds.tail_split(rows, 0.2, 10, ["symbol"])
    _, history = adam.train(split.where("role = 'fit'"), split.where("role = 'val'"), ["r1", "r5"], adam.Settings(epochs=2, batches=2))
    return history.select("epoch", R6(F.col("loss")).alias("loss"), R6(F.col("macro_f1")).alias("macro_f1"), "best_epoch", "stopped")
