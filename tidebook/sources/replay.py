"""A stored archive as a stream source that keeps to the pace of the original.

``prepare`` lays lines out by hour and order of receipt in blocks, with a small table of the blocks.  The source's offset is a place in that order
(hour, line); a batch takes the blocks whose last record is due: as long after the first record as the wall clock has moved on
since the replay began, times ``speed``.  What a limit holds back stays due.  The position and the start of the clock
are documents in the shared folder, so a restart resumes.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidebook.sources import documents

REPLAYED = "hour string, line long, recv_ns long, value string"

#: Lines of a block at most.
BLOCK = 10_000


def prepare(lines: DataFrame, path: str, block: int = BLOCK) -> None:
    """Writes value and recv_ns as the blocks of a replay: hour/block/part files and their table.

    Lines of one time keep the order of their text.  An hour's lines are numbered by ranges of time first (minutes), so no hour is one task.
    """
    hour = F.date_format(F.timestamp_seconds(F.floor(F.col("recv_ns") / 1_000_000_000)), "yyyy-MM-dd'T'HH")
    rows = lines.where(F.col("recv_ns").isNotNull()).select(hour.alias("hour"), F.floor(F.col("recv_ns") / 60_000_000_000).alias("minute"), "recv_ns", "value")
    counts = rows.groupBy("hour", "minute").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("hour").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("hour", "minute").orderBy("recv_ns", "value")) - 1
    placed = rows.withColumn("own", own).join(before, ["hour", "minute"]).withColumn("line", (F.col("own") + F.col("before")).cast("long"))
    placed = placed.select("hour", F.floor(F.col("line") / block).alias("block"), "line", "recv_ns", "value")
    placed.repartition("hour", "block").sortWithinPartitions("hour", "block", "line").write.mode("overwrite").partitionBy("hour", "block").parquet(f"{path}/blocks")
    table = lines.sparkSession.read.schema("hour string, block long, line long, recv_ns long").parquet(f"{path}/blocks").groupBy("hour", "block").agg(F.min("line").alias("first"), F.count("*").alias("n"), F.min("recv_ns").alias("since_ns"), F.max("recv_ns").alias("until_ns"))
    table.coalesce(1).sortWithinPartitions("hour", "block").write.mode("overwrite").parquet(f"{path}/table")


class Replay(DataSource):
    """``readStream.format("archive_replay").option("path", ..).option("state", ..).option("speed", 1).option("maxRecordsPerBatch", ..)``."""

    @classmethod
    def name(cls) -> str:
        return "archive_replay"

    def schema(self) -> str:
        return REPLAYED

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return ReplayReader(self.options)


class Blocks(InputPartition):
    """Blocks (hour, folder) that follow each other, of ``BLOCK`` lines together unless one is longer."""

    def __init__(self, blocks: list[tuple[str, str]]):
        self.blocks = blocks


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.state = options["path"], f"{options['state']}/replay.json"
        self.speed = float(options.get("speed", "1"))
        self.most = int(options.get("maxRecordsPerBatch", options.get("maxrecordsperbatch", "200000")))
        self._table = None

    def table(self) -> list[dict]:
        """hour, block, first, n, since_ns, until_ns of each block, in order; one small row each."""
        if self._table is None:
            files, place = documents.store(f"{self.path}/table")
            self._table = sorted(pq.read_table(place, filesystem=files).to_pylist(), key=lambda b: (b["hour"], b["block"]))
        return self._table

    def initialOffset(self) -> dict:  # noqa: N802
        return {"hour": "", "line": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        blocks, known = self.table(), documents.read(self.state)
        if not blocks:
            return self.initialOffset()
        if known is None:
            known = {"at": self.initialOffset(), "began_ns": time.time_ns()}
            documents.write(self.state, known)
        due = blocks[0]["since_ns"] + (time.time_ns() - known["began_ns"]) * self.speed
        at, n = known["at"], 0
        for b in blocks:
            if behind(b, at):
                continue
            if b["until_ns"] > due or (n and n + b["n"] > self.most):
                break
            at, n = {"hour": b["hour"], "line": b["first"] + b["n"]}, n + b["n"]
        if at != known["at"]:
            documents.write(self.state, known | {"at": at})
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, n = [], BLOCK
        for b in self.table():
            if behind(b, start) or not behind(b, end):
                continue
            if n + b["n"] > BLOCK:
                out, n = [*out, Blocks([])], 0
            out[-1].blocks.append((b["hour"], f"{self.path}/blocks/hour={b['hour']}/block={b['block']}"))
            n += b["n"]
        return out

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        for hour, folder in partition.blocks:
            files, place = documents.store(folder)
            rows = pq.read_table(place, filesystem=files, columns=["line", "recv_ns", "value"], partitioning=None).sort_by("line")
            hours = pa.array([hour] * rows.num_rows, pa.string())
            yield from rows.add_column(0, "hour", hours).cast(pa.schema([("hour", pa.string()), ("line", pa.int64()), ("recv_ns", pa.int64()), ("value", pa.string())])).to_batches()


def behind(block: dict, at: dict) -> bool:
    """Whether a block lies before a place."""
    return (block["hour"], block["first"]) < (at["hour"], at["line"])


def register(spark) -> None:
    spark.dataSource.register(Replay)
