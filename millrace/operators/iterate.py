"""Loops on the driver over plans, with their lineage cut."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. In local mode without one, a temporary folder stands for it; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints", f"millrace-{spark.sparkContext.applicationId}")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder. With ``spark.cleaner.referenceTracking.cleanCheckpoints``, which ``session`` sets, Spark deletes it once nothing refers to it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], object], max_rounds: int | None = None) -> DataFrame:
    """Applies step until measure no longer changes or max_rounds are done. Every round is checkpointed."""
    now = cut(start)
    seen, done = measure(now), 0
    while max_rounds is None or done < max_rounds:
        now = cut(step(now))
        new, done = measure(now), done + 1
        if new == seen:
            break
        seen = new
    return now
