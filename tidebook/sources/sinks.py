"""Sinks: partitioned archive, datasets with manifests, run artifacts, the trial ledger."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_archive(lines: DataFrame, root: str, recv_ns: str = "recv_ns", order: str | None = None) -> None:
    """stream/date=/hour=, gzip JSON lines by receive time; Spark never appends to a file, and commits seal them.  Lines of a task's file come by ``order``."""
    ts = F.timestamp_seconds(F.expr(f"{recv_ns} div 1000000000"))
    rows = lines.withColumn("date", F.date_format(ts, "yyyy-MM-dd")).withColumn("hour", F.date_format(ts, "HH"))
    if order:
        rows = rows.sortWithinPartitions("stream", "date", "hour", order)
    rows.select("value", "stream", "date", "hour").write.mode("append").partitionBy("stream", "date", "hour").option("compression", "gzip").text(root)


def write_dataset(frames: DataFrame, path: str, inputs: dict | None = None) -> DataFrame:
    """Frames as Parquet by symbol, intervals beside them, and a one-row manifest, which is returned."""
    frames.write.mode("overwrite").partitionBy("symbol").parquet(f"{path}/frames")
    back = frames.sparkSession.read.parquet(f"{path}/frames")
    spans = intervals(back)
    spans.write.mode("overwrite").parquet(f"{path}/intervals")
    manifest = back.agg(F.count("*").alias("frames"), F.min("event_ms").alias("first_ms"), F.max("event_ms").alias("last_ms")).crossJoin(spans.agg(F.count("*").alias("intervals"), F.max(F.col("n")).alias("longest")))
    manifest = manifest.withColumn("schema", F.lit("tidebook/1")).withColumn("inputs", F.lit(json.dumps(inputs or {}, sort_keys=True)))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def intervals(frames: DataFrame) -> DataFrame:
    """symbol, segment_id, first and last position, n."""
    return frames.groupBy("symbol", "segment_id").agg(F.min("seq").alias("start"), F.max("seq").alias("stop"), F.count("*").alias("n"))


def write_features(rows: DataFrame, path: str, names: tuple[str, ...]) -> None:
    rows.select("symbol", "segment_id", "seq", *(F.col(n).cast("float").alias(n) for n in names)).write.mode("overwrite").parquet(path)


def log_trial(spark: SparkSession, path: str, record: dict) -> None:
    """Appends one record; called before the run and once more after it."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def trials(spark: SparkSession, path: str) -> DataFrame:
    """started, finished."""
    return trial_counts(spark.read.text(path))


def trial_counts(records: DataFrame) -> DataFrame:
    """started, finished of a ledger's lines."""
    state = F.get_json_object("value", "$.state")
    return records.agg(F.count_if(state == "started").alias("started"), F.count_if(state == "finished").alias("finished"))


def write_run(spark: SparkSession, path: str, record: dict) -> None:
    spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_facts(facts: DataFrame, path: str) -> DataFrame:
    """A one-row table of figures as one JSON document; it is read back and returned."""
    facts.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return facts.sparkSession.read.schema(facts.schema).json(path)


def rewrite_repaired(lines: DataFrame, root: str) -> None:
    """Salvaged lines (path, line_no, value) as sealed files anew, one folder for each damaged file; the damaged ones stay as they are."""
    source = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.jsonl\.gz.*$", "")
    rows = lines.withColumn("source", source).repartition("source").sortWithinPartitions("source", "path", "line_no")
    rows.select("value", "source").write.mode("overwrite").partitionBy("source").option("compression", "gzip").text(root)
