"""A session with the settings that the library's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "millrace", master: str | None = None, max_partition_bytes: int | None = None, **conf: object) -> SparkSession:
    """UTC, ANSI arithmetic, adaptive execution, and checkpoints that go with what refers to them.

    master is for local runs; clusters set their own. max_partition_bytes is how much of a file a task reads. conf has
    further settings, with underscores for the dots.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if max_partition_bytes:
        settings["spark.sql.files.maxPartitionBytes"] = str(max_partition_bytes)
    builder = SparkSession.builder.appName(name)
    for key, value in (settings | {k.replace("_", "."): str(v) for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return (builder.master(master) if master else builder).getOrCreate()
