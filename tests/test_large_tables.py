"""What only shows on larger tables: large ids, long groups, many draws, chance bytes."""

from __future__ import annotations

import gzip
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import book, cost, gaps, trust
from tidebook.operators import frames as W
from tidebook.plans import feeds, streams, registry  # noqa: F401
from tidebook.sources import archive, sinks
from tidebook.streaming import sessions


def test_draws_of_a_few_keys_are_dealt_and_not_broadcast(spark):
    series = spark.range(500).selectExpr("cast(id % 2 as string) as symbol", "id as seq", "cast(id % 7 as double) as edge")
    plan = cost.bootstrap(series, ["symbol"], 20, 50)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" in plan


def test_sizes_without_larger_units_stay_in_the_last_one(spark):
    n = spark.range(1).select(S.human_bytes(F.lit(6_000_000_000), ("KB", "MB")).alias("mb"), S.human_bytes(F.lit(6_000_000_000)).alias("gb")).head()
    assert tuple(n) == ("5722.0 MB", "5.6 GB")


def test_ends_of_a_long_array_are_taken_once(spark):
    """20,000 values took 800 million steps where every bar looked for the ends."""
    since = time.monotonic()
    bars = spark.range(20_000).agg(F.array_sort(F.collect_list("id")).alias("v")).select(S.sparkline(F.col("v")).alias("bars")).head()["bars"]
    assert (len(bars), bars[0], bars[-1]) == (20_000, "▁", "█") and time.monotonic() - since < 10


@pytest.mark.parametrize("name", ["st09_minute_metrics", "k04_k01_routes", "k01_st12_epochs"])
def test_positions_over_a_million_move_nothing_past_the_hour(spark, tmp_path, name):
    duck = duckdb.connect()
    duck.execute("create table events as select 5000000 + i as event_id, timestamp '2024-01-01 00:59:59.998' as ts, i % 3 as user_id, 'view' as event_type, 1.0 as value, '{\"k\": ' || i || '}' as props from range(20) t(i)")
    duck.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = registry.QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = duck.execute(f"select {columns} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_a_head_inside_a_cut_member_is_its_own_data():
    inside = gzip.compress(b"x" * 50)[:10] + b"\xff" * 40
    cut = gzip.compress(b'{"a":1}\n' + inside, compresslevel=0)[:-8]
    assert archive.salvage(cut)[1:] == (1, 1)
    torn = gzip.compress(b'{"a":1}\n' * 50)[:-8] + gzip.compress(b'{"b":2}\n')
    assert archive.salvage(torn)[0].endswith(b'{"b":2}\n')


def test_files_are_read_some_lines_at_a_time():
    n = 600_000
    content = gzip.compress(b'{"a":1234567}\n' * n + b"torn", compresslevel=1)
    for raw, whole in ((content, True), (content[:-8], False)):
        found = archive.Readable(raw)
        sizes = [len(lines) for lines, torn in archive.parted(found) if not torn]
        assert found.whole == whole and sum(sizes) == n and max(sizes) < n
        assert archive.count_lines(raw) == (n, whole)


def test_first_records_and_hours_open_only_what_they_need(spark, tmp_path):
    hour = 3_600_000_000_000
    rows = spark.range(40).select(F.concat(F.lit('{"n":'), "id", F.lit("}")).alias("value"), F.lit("depth").alias("stream"), (F.col("id") * hour / 10 + F.lit(7)).cast("long").alias("recv_ns"))
    root = f"file://{tmp_path}/archive"
    sinks.write_archive(rows.repartition(F.expr(f"recv_ns div {hour}")), root, "recv_ns", "recv_ns")
    whole = archive.read_lines(spark, root, "stream=depth")
    for n in (1, 10, 25, 100):
        got = archive.read_first_records(spark, root, "stream=depth", n)
        assert [r["value"] for r in got.collect()] == [r["value"] for r in archive.first_records(whole, n).collect()] == [f'{{"n":{i}}}' for i in range(min(n, 40))]
    # an hour without lines does not count
    folder = tmp_path / "archive" / "stream=depth" / "date=1970-01-01" / "hour=01"
    for f in folder.glob("*.gz"):
        f.write_bytes(gzip.compress(b""))
    for f in folder.glob(".*.crc"):
        f.unlink()
    for hours in (0, 1, 2, 3, 9):
        got = archive.read_first_hours(spark, root, "stream=depth", hours)
        assert sorted(r["value"] for r in got.collect()) == sorted(r["value"] for r in archive.first_hours(whole, hours).collect())
        assert hours != 1 or len(got.inputFiles()) < len(whole.inputFiles())


def test_places_by_stretches_of_time(spark):
    rows = spark.range(300).select(F.lit("a").alias("endpoint"), (F.col("id") * 7_000_000_000_000).alias("recv_ns"))
    got = W.numbered(rows, ["endpoint"], "recv_ns", "line", F.expr("recv_ns div 600000000000"))
    assert [r["line"] for r in got.orderBy("recv_ns").collect()] == list(range(300))


def test_short_symbols_are_walked_whole_and_sparse_ones_fill_their_buckets(spark):
    """Every symbol was cut at 65,536 positions, however few of its events lay there, and each piece took five passes."""
    sparse = lambda symbol, n: [(symbol, i * 1_000, i * 1_000 - 999, i * 1_000, i * 1_000 - 1_000 - (i % 9 == 8), i % 9 == 7) for i in range(1, n + 1)]
    event, snap = "symbol string, seq long, first_id long, final_id long, prev_id long, withheld boolean", "symbol string, update_id long, seq long"
    short = [r for s in range(20) for r in sparse(f"s{s}", 30)]
    snaps = spark.createDataFrame([(s, 1_000 * i, 0) for s in ("hot", *(f"s{s}" for s in range(20))) for i in range(0, 30, 3)], snap)
    labels = trust.label(spark.createDataFrame(short, event), snaps, bucket=64)
    assert labels._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    mixed = spark.createDataFrame(short + sparse("hot", 500), event)
    want = {}
    for symbol, rows in (("hot", sparse("hot", 500)), *((f"s{s}", sparse(f"s{s}", 30)) for s in range(20))):
        machine = book.Automaton()
        machine.add_snapshots([1_000 * i for i in range(0, 30, 3)])
        for _, seq, first, final, prev, held in rows:
            want[symbol, seq] = "withheld" if held else machine.step(first, final, prev)[0]
            if held:
                machine.withhold(final, prev)
    got = {(r["symbol"], r["seq"]): r["outcome"] for r in trust.label(mixed, snaps, bucket=64).collect()}
    assert got == want and {"applied", "desync"} <= set(want.values())
    rows = trust.id_rows(mixed.where("symbol = 'hot'"), snaps, F.floor(F.col("seq") / 64).cast("long"))
    counts = rows.where("kind > 0").groupBy("symbol", "bucket").agg(F.count("*").alias("n"))
    sizes = sorted(r["count"] for r in trust.filled(rows.where("kind > 0"), counts, 64).groupBy("bucket").count().collect())
    assert len(sizes) == 8 and sizes[-1] == 64


def test_levels_go_to_the_replay_as_text(spark):
    """Nested arrays, null for all events but those with a snapshot, took longer on their way to Python than the replay."""
    level = "array<array<string>>"
    events = spark.createDataFrame([("x", i, i, i, i, i - 1, [["1.0", str(i)]], None if i == 2 else [["1.1", "2"]]) for i in (1, 2)], f"symbol string, seq long, event_ms long, first_id long, final_id long, prev_id long, bids {level}, asks {level}")
    snaps = spark.createDataFrame([("x", 0, [["0.9", "5"]], [])], f"symbol string, update_id long, bids {level}, asks {level}")
    states = book.replay(events, snaps, 0.1)
    assert "to_json" in states._jdf.queryExecution().analyzed().toString()
    got = [(r["outcome"], [tuple(x) for x in r["bids"]], [tuple(x) for x in r["asks"]]) for r in states.orderBy("seq").collect()]
    assert got == [("applied", [(1.0, float(i)), (0.9, 5.0)], [(1.1, 2.0)]) for i in (1, 2)]


@pytest.mark.parametrize("kind", ["gaps", "outages"])
def test_many_keys_share_the_visits_of_the_state(spark, tmp_path, kind):
    """Every symbol had its own visit of the state in every batch, which took longer than its few rows."""
    n = 2_000
    if kind == "gaps":
        rows = spark.range(3 * n).selectExpr(f"cast(id % {n} as string) as symbol", "id as seq", "'event' as kind", f"10 * (id div {n}) - cast(id % 7 = 0 as long) as prev_id", f"10 * (id div {n}) + 10 as final_id")
        want = gaps.sequence_gaps(rows, ["symbol"]).select("symbol", "seq", "expected_prev", "prev_id", "delta")
    else:
        rows = spark.range(3 * n).selectExpr(f"cast(id % {n} as string) as endpoint", "id as at_ns", f"if(id div {n} = 1, 'connect', 'disconnect') as state")
        want = rows.where(f"at_ns < {n}").selectExpr("endpoint", "'closed'", "at_ns", f"at_ns + {n}", f"{n} / 1e9D").union(rows.where("state = 'disconnect'").selectExpr("endpoint", "'open'", "at_ns", "null", "null"))
    order = "seq" if kind == "gaps" else "at_ns"
    sessions.prepare(spark)
    for i in (0, 1):  # the last row of every key comes after a restart
        rows.where(f"{order} div {2 * n} = {i}").write.mode("append").parquet(f"{tmp_path}/in")
        out = getattr(sessions, kind)(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        assert 0 < max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 512
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").drop("kind")
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    assert text(got) == text(want) and got.count() > 500


def test_streamed_ids_keep_all_digits_and_may_be_unknown(spark):
    big = 1 << 60
    rows = [("a", 0, "event", 0, big), ("a", 1, "event", big + 1, big + 10), ("a", 2, "connect", None, None), ("a", 3, "event", 5, 6), ("a", 4, "event", None, 7), ("a", 5, "event", 7, None), ("a", 6, "event", 1, 2), ("a", 7, None, 1, 3)]
    df = spark.createDataFrame(rows, "symbol string, seq long, kind string, prev_id long, final_id long")
    got = sorted((r["seq"], r["expected_prev"], r["got_prev"], r["delta"]) for r in streams.fed(df, "seq", sessions.gaps, slices=2).collect())
    assert got == [(1, big, big + 1, 1), (7, 2, 1, -1)]


def test_rows_of_a_stream_are_made_once(spark):
    """The ends and every slice each made all rows anew."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(60).selectExpr("'a' as endpoint", "id as at_ns", "'connect' as state")
    assert streams.fed(rows.mapInArrow(count, rows.schema), "at_ns", sessions.outages, slices=3).count() == 0
    assert made.value == 60
