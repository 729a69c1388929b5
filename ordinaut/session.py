"""A Spark session with the settings that the library's plans assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session, or the running one.  ANSI stays on, timestamps are UTC, skewed joins are split at run time."""
    cpus = cpus or os.cpu_count() or 1
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.enabled", "false")
    if "spark.master" not in conf:
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
