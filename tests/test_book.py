from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidebook.operators import book
from tidebook.sources import simulator

LEVELS = "array<array<string>>"
EVENT = f"symbol string, seq long, event_ms long, first_id long, final_id long, prev_id long, bids {LEVELS}, asks {LEVELS}"
SNAP = f"symbol string, update_id long, bids {LEVELS}, asks {LEVELS}"


def side(mid, sign, n=12):
    return [[f"{mid + sign * 0.1 * (i + 1):.2f}", f"{1.0 + i:.3f}"] for i in range(n)]


def snap(update_id, symbol="x", mid=63590.0, n=12):
    return (symbol, update_id, side(mid, -1, n), side(mid, 1, n))


def events(triples, symbol="x", bids=(), asks=()):
    return [(symbol, n, 1_000 + n, *t, list(bids), list(asks)) for n, t in enumerate(triples)]


def replay(spark, rows, snapshots, **kw):
    out = book.replay(spark.createDataFrame(rows, EVENT), spark.createDataFrame(snapshots, SNAP), 0.1, **kw)
    return sorted(out.collect(), key=lambda r: (r["symbol"], r["seq"]))


GOLDEN = [(1001, 1005, 1000), (1006, 1010, 1005), (1900, 1950, 1899), (2001, 2005, 2000), (2006, 2010, 2005)]


def test_golden_replay(spark):
    out = replay(spark, events(GOLDEN), [snap(1000), snap(2000)])
    assert [r["update_id"] for r in out if r["outcome"] == "applied"] == [1005, 1010, 2005, 2010]
    broken = [r for r in out if r["outcome"] == "desync"]
    assert [(r["expected"], r["got"]) for r in broken] == [(1010, 1899)]
    assert [r["segment_id"] for r in out] == [0, 0, 0, 1, 1]


def test_labels_tell_every_outcome(spark):
    rows = events([(1, 5, 0), *GOLDEN, (1990, 2000, 1989), (2011, 2015, 2010)])
    labels = book.label_events(spark.createDataFrame(rows, EVENT), spark.createDataFrame([snap(1000), snap(2000)], SNAP))
    got = [r["outcome"] for r in labels.orderBy("seq").collect()]
    assert got == ["unanchored", "applied", "applied", "desync", "applied", "applied", "skipped", "applied"]


def test_the_breaking_event_is_no_anchor(spark):
    rows = events([(1001, 1005, 1000), (1010, 1020, 1009), (1021, 1025, 1020)])
    out = replay(spark, rows, [snap(1000), snap(1012)])
    assert [r["outcome"] for r in out] == ["applied", "desync"]


def test_naive_arm_never_breaks(spark):
    out = replay(spark, events(GOLDEN), [snap(1000), snap(2000)], trust=False)
    assert [r["outcome"] for r in out] == ["applied"] * 5 and {r["segment_id"] for r in out} == {0}


def test_default_book_and_quantity_zero(spark):
    out = replay(spark, events([(1001, 1005, 1000)], bids=[["63589.90", "0"]], asks=[["63590.05", "0"], ["70000", "0"]]), [snap(1000)])
    (r,) = out
    assert r["bids"][0]["p"] == 63589.8 and r["asks"][0]["p"] == 63590.2
    (r,) = replay(spark, events([(1001, 1005, 1000)]), [snap(1000)])
    assert (r["bids"][0]["p"], r["asks"][0]["p"], len(r["bids"])) == (63589.9, 63590.1, 10)


def test_float_path_deletes_the_level_it_inserted(spark):
    rows = [("x", 0, 1, 1001, 1001, 1000, [["63589.70", "9"]], []), ("x", 1, 2, 1002, 1002, 1001, [[str(6358.97 * 10), "0"]], [])]
    out = replay(spark, rows, [snap(1000)], shown=20)
    assert 63589.7 in [x["p"] for x in out[0]["bids"]] and 63589.7 not in [x["p"] for x in out[1]["bids"]]


def test_later_entries_of_one_event_win(spark):
    (r,) = replay(spark, events([(1001, 1005, 1000)], bids=[["63589.90", "5"], ["63589.90", "7"]]), [snap(1000)])
    assert r["bids"][0]["q"] == 7.0


def test_frame_has_forty_cells_and_pads(spark):
    states = book.replay(spark.createDataFrame(events([(1001, 1005, 1000)]), EVENT), spark.createDataFrame([snap(1000, n=3)], SNAP), 0.1)
    frame = book.frame_layout(states).first()["frame"]
    assert len(frame) == 40
    assert frame[8] == pytest.approx(63590.3) and frame[12] == pytest.approx(63590.3) and frame[13] == 0.0 and frame[39] == 0.0
    split = book.split_layout(book.frame_layout(states)).first()
    assert len(split["ask_p"]) == 10 and split["bid_q"][:4] == [1.0, 2.0, 3.0, 0.0]


def test_crossed_book_fails_only_when_strict(spark):
    states = book.replay(spark.createDataFrame(events([(1001, 1005, 1000)], bids=[["63590.50", "1"]]), EVENT), spark.createDataFrame([snap(1000)], SNAP), 0.1)
    assert book.faults(states).first()["crossed"]
    with pytest.raises(Exception, match="bad book at update 1005"):
        book.strict(states).collect()
    good = book.replay(spark.createDataFrame(events([(1001, 1005, 1000)]), EVENT), spark.createDataFrame([snap(1000)], SNAP), 0.1)
    assert book.strict(good).count() == 1


def test_pruning_keeps_the_best():
    b = book.Book(0.1, keep=3)
    b.load([], [])
    b.apply([[str(100 + i), "1"] for i in range(7)], [])
    assert [x["p"] for x in b.top()[0]] == [106.0, 105.0, 104.0]


def test_trusted_arm_equals_truth_and_naive_does_not(spark):
    """Events are lost, two symbols are replayed: trusted states equal the complete history, naive ones go wrong."""
    es, ss = simulator.stream(spark, 2, 400, seed=3)
    es = es.cache()
    later = es.where("seq % 90 = 80").select("symbol", "prev_id")
    truth = {(r["symbol"], r["update_id"]): r for r in book.replay(es, ss, simulator.TICK).collect()}
    # snapshots on the way come from the true history
    books = [(s, u, [[f"{x['p']:.2f}", f"{x['q']:.3f}"] for x in r["bids"]], [[f"{x['p']:.2f}", f"{x['q']:.3f}"] for x in r["asks"]]) for (s, u), r in truth.items()]
    want = {(r["symbol"], r["prev_id"]) for r in later.collect()}
    extra = spark.createDataFrame([b for b in books if (b[0], b[1]) in want], SNAP)
    lossy = es.where("seq % 37 <> 36")
    assert len(truth) == 800
    trusted = book.replay(lossy, ss.select("symbol", "update_id", "bids", "asks").unionByName(extra), simulator.TICK, shown=3).where("outcome = 'applied'").collect()
    naive = book.replay(lossy, ss, simulator.TICK, trust=False, shown=3).collect()
    differs = lambda rows: sum([tuple(x) for x in r["bids"]] != [tuple(x) for x in truth[r["symbol"], r["update_id"]]["bids"][:3]] for r in rows)
    assert len(trusted) > 100 and len({(r["symbol"], r["segment_id"]) for r in trusted}) > 2
    assert {r["segment_id"] for r in naive} == {0} and differs(naive) > 0
    # books of ten snapshot levels can run short, but the best levels are right
    assert differs(trusted) <= len(trusted) * 0.02


def test_partitioning_changes_nothing(spark):
    es, ss = simulator.stream(spark, 3, 120, seed=1)
    lossy = es.where("seq % 25 <> 24")
    one = [tuple(r) for r in book.replay(lossy.coalesce(1), ss, simulator.TICK).orderBy("symbol", "seq").collect()]
    many = [tuple(r) for r in book.replay(lossy.repartition(7), ss, simulator.TICK).orderBy("symbol", "seq").collect()]
    assert one == many


def test_relational_top_equals_replay(spark):
    es, ss = simulator.stream(spark, 1, 100, seed=5)
    flat = lambda df, c, s, seq: df.select("symbol", F.lit(s).alias("side"), F.explode(c).alias("x"), seq.alias("seq"))
    rows = None
    for c, s in (("bids", "b"), ("asks", "a")):
        mine = flat(ss, c, s, F.lit(-1).cast("long")).unionByName(flat(es, c, s, F.col("seq")))
        rows = mine if rows is None else rows.unionByName(mine)
    deltas = rows.select("symbol", "side", F.floor(F.col("x")[0].cast("double") / 0.1 + 0.5).alias("ticks"), F.col("x")[1].cast("double").alias("q"), "seq")
    got = {(r["side"], r["level"]): (round(r["ticks"] * 0.1, 8), r["q"]) for r in book.top_of_deltas(deltas, 99).collect()}
    last = book.replay(es, ss, simulator.TICK).orderBy(F.desc("seq")).first()
    want = {(s, i + 1): (x["p"], x["q"]) for s, c in (("b", "bids"), ("a", "asks")) for i, x in enumerate(last[c])}
    assert got == want


def test_tick_check(spark):
    prices = spark.createDataFrame([("x", f"{100 + i * 0.5:.1f}") for i in range(150)], "symbol string, price string")
    assert book.tick_of(prices).first()["tick"] == 0.5
    book.check_tick(prices, 0.5)
    with pytest.raises(ValueError, match="steps of 0.5"):
        book.check_tick(prices, 0.1)


def test_repair_over_withheld_events(spark):
    """Every loss is kept aside: each break is repaired, states equal the whole history, and segments are one more than losses."""
    es, ss = simulator.stream(spark, 1, 300, seed=3)
    truth = {r["update_id"]: r for r in book.replay(es, ss, simulator.TICK).collect()}
    lost = [s for s in range(300) if s % 37 == 36]
    marked = es.withColumn("withheld", F.col("seq").isin(lost))
    out = book.replay(marked, ss, simulator.TICK).orderBy("seq").collect()
    assert len(out) == 300 - len(lost) and {r["outcome"] for r in out} == {"applied", "repaired"}
    assert all((r["bids"], r["asks"]) == (truth[r["update_id"]]["bids"], truth[r["update_id"]]["asks"]) for r in out)
    assert len({r["segment_id"] for r in out}) == len(lost) + 1


def test_a_hole_that_was_not_punched_is_not_repaired(spark):
    es, ss = simulator.stream(spark, 1, 100, seed=3)
    marked = es.where("seq not between 30 and 37").withColumn("withheld", F.col("seq") == 38)
    out = book.replay(marked, ss, simulator.TICK).orderBy("seq").collect()
    assert [r["outcome"] for r in out] == ["applied"] * 30 + ["desync"]
