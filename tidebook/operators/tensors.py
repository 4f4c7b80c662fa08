"""Windows of frames for models: built where they are used, never stored.

Rows are dealt by (symbol, segment, bucket of positions), and a bucket gets the last ``window - 1`` rows of the one before it, so
windows across its edge are whole while none crosses a segment's.  Inside a task a bucket's frames are one matrix, and its
windows are views of it: a hundred frames a window cost nothing until a block of them is normalised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators import frames as W

#: Windows that are normalised at a time.
BLOCK = 1_024


def normalised(views: np.ndarray, last_mid: np.ndarray, volume_mean: float = 0.0, volume_sd: float = 1.0) -> np.ndarray:
    """Windows (n, window, columns) with prices (even columns) in basis points of the last mid and volumes (odd ones) as standardised logs."""
    x = views.astype(np.float64)
    x[:, :, 0::2] = (x[:, :, 0::2] - last_mid[:, None, None]) / last_mid[:, None, None] * 1e4
    x[:, :, 1::2] = (np.log1p(x[:, :, 1::2]) - volume_mean) / volume_sd
    return x


def map_windows(rows: DataFrame, ends: Column, window: int, function: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, volume: tuple[float, float] = (0.0, 1.0), bucket: int = 8_192) -> DataFrame:
    """symbol, segment_id, seq and ``schema``: what ``function`` makes of the normalised windows that end at the rows where ``ends`` holds.

    rows: symbol, segment_id, seq, pos (in the segment), mid and ``frame``, an array of prices and volumes in turn.
    """
    kept = rows.withColumn("_end", ends)
    spread = W.haloed(kept, "pos", before=window - 1, bucket=bucket).select("symbol", "segment_id", "_bucket", "pos", "seq", "mid", F.col("frame").cast("array<double>").alias("frame"), (F.col("_end") & ~F.col("_halo")).alias("_end"))
    ordered = spread.repartition("symbol", "segment_id", "_bucket").sortWithinPartitions("symbol", "segment_id", "_bucket", "pos")
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (symbol, segment), part in buckets(batches):
            at = np.flatnonzero(part["_end"])
            if not len(at):
                continue
            views = np.lib.stride_tricks.sliding_window_view(part["frame"], window, axis=0).transpose(0, 2, 1)
            for i in range(0, len(at), BLOCK):
                some = at[i : i + BLOCK]
                found = function(normalised(views[some - window + 1], part["mid"][some], *volume))
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(some), pa.string()), pa.array([segment] * len(some), pa.int64()), pa.array(part["seq"][some]), *(pa.array(found[n]) for n in names)], names=["symbol", "segment_id", "seq", *names])

    return ordered.mapInArrow(run, f"symbol string, segment_id long, seq long, {schema}")


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """((symbol, segment), columns) of one bucket at a time."""
    key, held = None, []

    def whole() -> dict[str, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        frame = rows["frame"].combine_chunks()
        return {c: rows[c].to_numpy() for c in ("seq", "mid", "_end")} | {"frame": frame.flatten().to_numpy(zero_copy_only=False).reshape(len(frame), -1)}

    for batch in batches:
        if not batch.num_rows:
            continue
        symbols, segments, numbers = (batch.column(c).dictionary_encode() for c in range(3))
        codes = [x.indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in (symbols, segments, numbers)]
        change = np.any([c[1:] != c[:-1] for c in codes], axis=0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mine = tuple(batch.column(c)[a].as_py() for c in range(3))
            if held and mine != key:
                yield key[:2], whole()
                held = []
            key = mine
            held.append(batch.slice(a, b - a))
    if held:
        yield key[:2], whole()
