"""The folder that driver and executors share, for tables that outlive one plan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession) -> str:
    """A folder of its own under ``spark.checkpoint.dir``; only a session in one process may leave that unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or tempfile.gettempdir() + '/checkpoints'}/tidebook-{uuid.uuid4().hex}"
