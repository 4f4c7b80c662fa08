"""End-to-end studies: dataset build, walk-forward evaluation, cost floor, gap study, published benchmark.

Each takes DataFrames and gives DataFrames; a trial ledger is written before a run and after it where a path is
given.  Scores come from models fitted to their optimum, so no test block is looked at while fitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions import scalars as S
from tidebook.operators import book, cost, folds, metrics, ml
from tidebook.operators import frames as W
from tidebook.sources import fi2010, simulator, sinks


def build_frames(events: DataFrame, snapshots: DataFrame, tick: float, levels: int = 10) -> DataFrame:
    """Frames of trusted book states: symbol, segment_id, seq, update_id, event_ms, mid, spread, frame and its four arrays."""
    states = book.replay(events, snapshots, tick, shown=levels).where("outcome in ('applied', 'repaired') and size(bids) > 0 and size(asks) > 0")
    rows = book.split_layout(book.frame_layout(states, levels))
    bid, ask = F.get("bid_p", F.lit(0)), F.get("ask_p", F.lit(0))
    return rows.select("symbol", "segment_id", "seq", "update_id", "event_ms", S.mid(bid, ask).alias("mid"), (ask - bid).alias("spread"), "frame", "ask_p", "ask_q", "bid_p", "bid_q")


def counters(events: DataFrame, snapshots: DataFrame, hour_ms: int = 3_600_000) -> DataFrame:
    """hour, outcome, n of the replay."""
    labels = book.label_events(events, snapshots)
    return events.select("symbol", "seq", "event_ms").join(labels, ["symbol", "seq"]).groupBy(F.floor(F.col("event_ms") / hour_ms).alias("hour"), "outcome").agg(F.count("*").alias("n"))


def labelled_ends(frames: DataFrame, k: int, window: int = 100, mode: str = "forward", latency: int = 0) -> DataFrame:
    """Window ends with ``bp``, the move that their label is cut from."""
    bp = W.forward_bp(F.col("mid"), k, latency) if mode == "forward" else W.smoothed_bp(F.col("mid"), k)
    ends = W.valid_ends(W.positions(frames.withColumn("bp", bp)), window, k, latency)
    return ends.where("bp is not null")


def evaluate(frames: DataFrame, k: int, n_folds: int = 5, window: int = 100, multiplier: float = 1.0, columns: tuple[str, ...] = W.FEATURES, latency: int = 0, purge: int | None = None, mode: str = "forward", clip: bool = False, stride: int = 1, max_iter: int = 100) -> DataFrame:
    """fold, frame_id, y, p, bp, confidence: walk-forward predictions with fold-local thresholds and statistics.

    ``columns`` = ml.RETURNS_ONLY gives the null model.
    """
    ends = labelled_ends(W.features(frames), k, window, mode, latency).withColumn("frame_id", F.col("seq"))
    rows = folds.make_folds(ends, n_folds, k, purge=purge, latency=latency)
    alpha = F.broadcast(folds.fold_alpha(rows, multiplier, clip))  # a row a fold
    rows = rows.join(alpha, "fold").withColumn("y", S.label_from_bp(F.col("bp"), F.col("alpha")))
    if stride > 1:
        train = folds.strided(rows.where("role = 'train'"), ["fold"], "frame_id", stride)
        rows = train.unionByName(rows.where("role = 'test'"))
    return ml.fit_predict(rows.select("fold", "role", "symbol", "frame_id", "bp", "y", *columns), list(columns), keep=["symbol", "frame_id", "bp"], max_iter=max_iter)


def scores(predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scores by fold, their mean and deviation)."""
    by_fold = metrics.summary(metrics.class_scores(metrics.confusion(predictions, keys=["fold"]), ["fold"]), ["fold"])
    return by_fold, metrics.across_folds(by_fold, ["accuracy", "macro_f1", "weighted_f1"])


def cost_floor(frames: DataFrame, k: int, latencies_ms: tuple[float, ...] = (0, 100, 300, 500, 800, 1200), costs: tuple[float, ...] = (5.0, 10.0, 15.0), block: int = 200, resamples: int = 1_000, **options) -> tuple[DataFrame, DataFrame]:
    """(ms, edge with naive and bootstrap intervals; the same less each cost).  Labels depend on latency, so each is fitted anew."""
    out = None
    for ms in latencies_ms:
        latency = round(ms / 100)  # halves to even, as frames come every 100 ms
        trades = cost.gross_edges(evaluate(frames, k, latency=latency, **options).withColumn("ms", F.lit(float(ms))))
        summary = cost.edge_summary(trades, ["ms"])
        interval = cost.bootstrap(trades.withColumn("seq", F.col("frame_id")), ["ms"], block, resamples).select("ms", F.col("lo").alias("block_lo"), F.col("hi").alias("block_hi"))
        mine = summary.join(interval, "ms").withColumn("width_ratio", F.try_divide(F.col("block_hi") - F.col("block_lo"), F.col("hi") - F.col("lo")))
        out = mine if out is None else out.unionByName(mine)
    return out, cost.net_edges(out, list(costs))


def gap_study(events: DataFrame, snapshots: DataFrame, tick: float, rates: tuple[float, ...] = (0.0, 0.005, 0.02), seed: int = 0, k: int = 10, window: int = 20, least_ends: int = 0, **options) -> DataFrame:
    """rate, arm (trusted, naive, naive@trusted), ends, crossed frames, macro F1, edge of each drop rate.

    Both arms lose the same events.  The third arm is the naive book on the trusted windows, matched by update id.
    """
    out = None
    for rate in rates:
        faulty = simulator.with_faults(events, drop=rate, seed=seed).withColumn("withheld", F.coalesce(F.col("fault") == "drop", F.lit(False))).drop("fault", "arrival")
        trusted = build_frames(faulty, snapshots, tick)
        naive_states = book.replay(faulty.where("not withheld").drop("withheld"), snapshots, tick, trust=False)
        naive = book.split_layout(book.frame_layout(naive_states.where("size(bids) > 0 and size(asks) > 0")))
        bid, ask = F.get("bid_p", F.lit(0)), F.get("ask_p", F.lit(0))
        naive = naive.withColumn("mid", S.mid(bid, ask)).withColumn("spread", ask - bid)
        arms = {"trusted": (trusted, None), "naive": (naive, None), "naive@trusted": (naive, labelled_ends(trusted, k, window))}
        for arm, (rows, twins) in arms.items():
            crossed = rows.agg(F.count_if(F.col("spread") <= 0)).first()[0]
            ends = labelled_ends(rows, k, window)
            if twins is not None:
                ends = book.matched_ends(twins, ends, k)
            n = ends.count()
            row = {"rate": float(rate), "arm": arm, "ends": n, "crossed": crossed, "macro_f1": None, "edge": None}
            if n > least_ends:
                kept = W.features(rows).join(ends.select("symbol", "seq", "bp", "pos", "len"), ["symbol", "seq"])
                row |= measure(kept, k, **options)
            mine = events.sparkSession.createDataFrame([tuple(row.values())], "rate double, arm string, ends long, crossed long, macro_f1 double, edge double")
            out = mine if out is None else out.unionByName(mine)
    return out


def measure(ends: DataFrame, k: int, n_folds: int = 3, multiplier: float = 1.0, max_iter: int = 50) -> dict:
    """macro_f1 and edge of one arm's ends with features."""
    rows = folds.make_folds(ends.withColumn("frame_id", F.col("seq")), n_folds, k)
    rows = rows.join(F.broadcast(folds.fold_alpha(rows, multiplier, clip=True)), "fold").withColumn("y", S.label_from_bp(F.col("bp"), F.col("alpha")))
    predictions = ml.fit_predict(rows.select("fold", "role", "frame_id", "bp", "y", *W.FEATURES), list(W.FEATURES), keep=["frame_id", "bp"], max_iter=max_iter)
    _, mean = scores(predictions)
    edge = cost.gross_edges(predictions).agg(F.avg("edge")).first()[0]
    return {"macro_f1": mean.first()["mean_macro_f1"], "edge": edge}


def inflation(study: DataFrame) -> DataFrame:
    """rate, what each untrusted arm adds to F1 and edge, and the share of ends that trust keeps."""
    wide = study.groupBy("rate").pivot("arm", ["trusted", "naive", "naive@trusted"]).agg(F.first("macro_f1").alias("f1"), F.first("edge").alias("edge"), F.first("ends").alias("ends"))
    c = lambda arm, x: F.col(f"`{arm}_{x}`")
    controlled = study.where("arm = 'naive@trusted'").select("rate").distinct()
    return wide.join(controlled, "rate", "left_semi").select(
        "rate", (c("naive", "f1") - c("trusted", "f1")).alias("f1_inflation"), (c("naive@trusted", "f1") - c("trusted", "f1")).alias("f1_controlled"),
        (c("naive", "edge") - c("trusted", "edge")).alias("edge_inflation"), F.try_divide(c("trusted", "ends"), c("naive", "ends")).alias("kept"),
    )


def label_report(frames: DataFrame, ks: tuple[int, ...], alphas: list[float], window: int = 100) -> DataFrame:
    """Class shares over a grid of horizons and thresholds; a window never reaches before its segment."""
    moves = None
    for k in ks:
        mine = labelled_ends(frames, k, max(window, k)).select(F.lit(k).alias("k"), "bp")
        moves = mine if moves is None else moves.unionByName(mine)
    return metrics.balance_grid(moves, frames.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double"))


def published_benchmark(train: DataFrame, test: list[DataFrame], horizons: tuple[int, ...] = fi2010.HORIZONS, max_iter: int = 50) -> DataFrame:
    """k, weighted_f1, macro_f1, published, gap of the null model on cells of the published files (``fi2010.load_matrix``)."""
    spark = train.sparkSession
    columns = [f"ret{n}" for n in fi2010.LAGS] + [f"rv{n}" for n in fi2010.SPANS]
    ready = lambda parts: fi2010.labels(fi2010.valid_rows(fi2010.returns(fi2010.segments(fi2010.joined([fi2010.events_of(p) for p in parts])))))
    fit, held = ready([train]), ready(test)
    out = None
    for k in horizons:
        pick = lambda rows, role, k=k: rows.select(F.lit(0).alias("fold"), F.lit(role).alias("role"), "frame_id", F.col(f"y{k}").alias("y"), *columns)
        predictions = ml.fit_predict(pick(fit, "train").unionByName(pick(held, "test")), columns, max_iter=max_iter)
        mine = metrics.summary(metrics.class_scores(metrics.confusion(predictions))).select(F.lit(k).cast("long").alias("k"), "weighted_f1", "macro_f1")
        out = mine if out is None else out.unionByName(mine)
    return fi2010.against_published(spark, out)


def recorded(spark, ledger: str, name: str, run):
    """Runs ``run`` between two records of the trial ledger."""
    sinks.log_trial(spark, ledger, {"run": name, "state": "started"})
    out = run()
    sinks.log_trial(spark, ledger, {"run": name, "state": "finished"})
    return out
