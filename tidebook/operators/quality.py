"""Archive quality: hourly counts, coverage, percentiles by rank, checks and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly(rows: DataFrame, time: str, stream: str, streams: list[str]) -> DataFrame:
    """hour and a count for each stream."""
    return rows.groupBy(F.date_trunc("hour", time).alias("hour")).pivot(stream, streams).count().na.fill(0)


def hour_spine(rows: DataFrame, hour: str = "hour") -> DataFrame:
    """Every hour from the first to the last of ``rows``."""
    return rows.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias(hour))


def on_spine(rows: DataFrame, columns: list[str], hour: str = "hour") -> DataFrame:
    """Rows for every hour, 0 where there was none."""
    return hour_spine(rows, hour).join(rows, hour, "left").na.fill(0, columns)


def by_rank(rows: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at index int(n * share) of the sorted values."""
    # counted by value first: a map-side aggregate, and the window goes over distinct values
    w = Window.partitionBy(*keys)
    counted = rows.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_c"))
    placed = counted.withColumn("_upto", F.sum("_c").over(w.orderBy(x))).withColumn("_n", F.sum("_c").over(w))
    return placed.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * F.lit(s)), F.col(x))).alias(name) for name, s in shares.items()))


def tail(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def thin_hours(counts: DataFrame, n: str = "n_depth", least: int = 20_000, hour: str = "hour") -> DataFrame:
    """Hours, not the first or last of more than two, with some events but fewer than ``least``."""
    ends = counts.agg(F.min(hour).alias("lo"), F.max(hour).alias("hi"), F.count("*").alias("all"))
    inner = (F.col("all") <= 2) | ((F.col(hour) > F.col("lo")) & (F.col(hour) < F.col("hi")))
    return counts.crossJoin(F.broadcast(ends)).where(inner & (F.col(n) > 0) & (F.col(n) < least)).drop("lo", "hi", "all")


def integrity(loss_pct: Column, gaps_per_hour: Column, reconnects: Column, failures: Column) -> Column:
    """100 less capped penalties, 0 at least."""
    lost = F.least(F.lit(30.0), 2 * loss_pct) + F.least(F.lit(30.0), gaps_per_hour / 2) + F.least(F.lit(20.0), reconnects) + F.least(F.lit(20.0), 5.0 * failures)
    return F.greatest(F.lit(0.0), 100 - lost)


def status(bad: Column, warn: Column) -> Column:
    return F.when(bad, "BAD").when(warn, "WARN").otherwise("OK")


def monitor_status(age_s: Column, healthy: Column, written: Column) -> Column:
    """NO HEARTBEAT over 180 s, DEGRADED, NOT WRITING, else LIVE."""
    return F.when(age_s.isNull() | (age_s > 180), "NO HEARTBEAT").when(~healthy, "DEGRADED").when(written <= 0, "NOT WRITING").otherwise("LIVE")


def healthy(missing_streams: Column, snapshot_failures: Column, write_failures: Column) -> Column:
    return (missing_streams == 0) & (snapshot_failures < 3) & (write_failures == 0)


def verdict(checks: DataFrame) -> DataFrame:
    """status, n, and whether the whole fails."""
    n = checks.groupBy("status").agg(F.count("*").alias("n"))
    return n.withColumn("fails", F.col("status") == "BAD")


def heat(states: DataFrame, tick: float, column: Column, share: float = 0.99) -> DataFrame:
    """col, row, qty: quantity by time column and whole ticks from the mid, rows within the ``share`` percentile of the distance."""
    level = F.explode(F.concat(F.transform("bids", lambda x: x), F.transform("asks", lambda x: x)))
    cells = states.withColumn("col", column).withColumn("_x", level).withColumn("row", F.rint((F.col("_x.p") - F.col("mid")) / F.lit(tick)).cast("long"))
    span = cells.agg(F.ceil(F.percentile(F.abs("row"), share)).alias("span"))
    return cells.crossJoin(F.broadcast(span)).where(F.abs("row") <= F.col("span")).groupBy("col", "row").agg(F.sum("_x.q").alias("qty"))


def projection(size: DataFrame, bytes_column: str, hours: str) -> DataFrame:
    """mb_day and mb_21_days at the observed rate."""
    rate = F.col(bytes_column) / 1e6 / F.col(hours) * 24
    return size.withColumn("mb_day", rate).withColumn("mb_21_days", rate * 21)


def least_count(n: Column, least: int = 1, otherwise: str = "BAD") -> Column:
    """OK where there are ``least`` and more, else ``otherwise``."""
    return F.when(n >= least, "OK").otherwise(otherwise)


def archive_checks(files: DataFrame, counts: DataFrame, stale_s: int = 3_600) -> DataFrame:
    """check, status: rotation (two sealed depth files), date boundary (two dates), stale unfinished files, trades and depth present.

    files: path, stream, date, age_s; counts: stream, n.  Both are aggregated to one row first.
    """
    sealed = F.col("path").endswith(".gz")
    seen = files.agg(F.count_if(sealed & (F.col("stream") == "depth")).alias("depth_files"), F.countDistinct("date").alias("dates"), F.count_if(~sealed & (F.col("age_s") > stale_s)).alias("stale"))
    n = lambda stream: F.coalesce(F.sum(F.when(F.col("stream") == stream, F.col("n"))), F.lit(0))
    both = seen.crossJoin(F.broadcast(counts.agg(n("trades").alias("trades"), n("depth").alias("depth"))))
    checks = {
        "rotation": least_count(F.col("depth_files"), 2, "WARN"), "date_boundary": least_count(F.col("dates"), 2, "WARN"), "stale_files": F.when(F.col("stale") == 0, "OK").otherwise("WARN"),
        "trades_present": least_count(F.col("trades")), "depth_present": least_count(F.col("depth")),
    }
    return both.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*checks.values()))).alias("check", "status"))


def heartbeat_checks(beats: DataFrame) -> DataFrame:
    """Adds self_reported, streams, reconnected, snapshots (each a status) to rows of heartbeat fields; a missing field is no fault."""
    field = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return beats.withColumns({
        "self_reported": F.when(field("healthy", True), "OK").otherwise("BAD"),
        "streams": F.when(field("missing_streams", 0) == 0, "OK").otherwise("BAD"),
        "reconnected": F.when(field("reconnects", 0) < 20, "OK").otherwise("WARN"),
        "snapshots": F.when(field("snapshot_failures", 0) == 0, "OK").otherwise("WARN"),
    })


def gate(age_s: Column, healthy: Column, most_s: float = 180.0) -> Column:
    """Whether a container counts as alive: a heartbeat under ``most_s`` old that says it is healthy."""
    return F.coalesce((age_s < most_s) & healthy, F.lit(False))
