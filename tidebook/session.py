"""Sessions for jobs and tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tidebook", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine counts on; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_ENV_LOADED"):
        builder = builder.master(master or "local[*]")
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
