"""Session factory: UTC, AQE, Arrow; partitions sized by the caller."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "postloom", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library expects; an active session is reused as it is."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if mem := os.environ.get("POSTLOOM_DRIVER_MEMORY"):
        conf["spark.driver.memory"] = mem
    return b.config(map=conf).getOrCreate()
