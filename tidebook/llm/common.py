"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only a session in one process (a local master, as in tests)
    may leave it unset, since its driver and executors have one disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more; it looks for them when the driver's heap is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Names of the folders that ``cut_lineage`` wrote in this process; nothing else is ever deleted.
_OWN: set[str] = set()
_WRITTEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def remove(df: DataFrame) -> None:
    """Deletes a table that ``cut_lineage`` wrote, once nothing reads it any more; other tables stay."""
    remove_paths(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def remove_paths(spark: SparkSession, places) -> None:
    for place in places:
        name = place.rsplit("/", 1)[-1]
        if name in _OWN:
            _OWN.discard(name)
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are cut inside are deleted at the end, but the last one: the result, written in full by then."""
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        remove_paths(spark, written[:-1])


def cut_lineage(df: DataFrame, compression: str = "zstd", **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    A lost executor then costs a re-read, not the whole lineage, and an iterative plan stays small.
    """
    spark = df.sparkSession
    name = f"tidebook-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _OWN.add(name)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    df.write.option("compression", compression).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, answers: DataFrame, keys: list[str], share: int = 1_000) -> DataFrame:
    """Every row of ``rows`` with the other columns of the one row of ``answers`` that has its keys (an inner join).

    Keys that hold one row in ``share`` or more number ``share`` at most: their answers are broadcast, so their rows never meet.  All others
    go through an exchange, where none is hot.  ``rows`` is read three times, so it should be a written table.
    """
    n = rows.count()
    hot = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") * share >= n).drop("_n")
    known = answers.join(F.broadcast(hot), keys, "left_semi").withColumn("_hot", F.lit(True))
    met = rows.join(F.broadcast(known), keys, "left")
    rest = met.where("_hot is null").select(*rows.columns).join(answers, keys)
    return met.where("_hot").drop("_hot").unionByName(rest)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, held_modulus: int = 3, held_remainder: int = 1) -> DataFrame:
    """doc_id, text, y of a bounded training sample: ``per_class`` rows of each class at most.

    Rows whose crc32(doc_id) falls on the held-out remainder never take part.  The sample is the
    head of a hash order, so it is the same on every run; its ids (2 * per_class at most) are
    what gets broadcast.
    """
    usable = labels.where(F.col(target).isin(0, 1) & (crc_mod("doc_id", held_modulus) != held_remainder)).select("doc_id", F.col(target).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    head = lambda y: usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    ids = head(0).unionByName(head(1))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def small(batches, rows: int = 1_024):
    """Arrow batches cut to ``rows`` rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Text of a home at least, where a table is small for the session's partitions.
LEAST_HOME_BYTES = 1 << 20


def homes_for(spark: SparkSession, size: int, home_bytes: int) -> int:
    """How many homes documents are dealt over: ``home_bytes`` of text each, or less if partitions would stay empty."""
    many = lambda each: max(1, -(-size // each))
    return max(many(home_bytes), min(parts(spark), many(min(home_bytes, LEAST_HOME_BYTES))))
