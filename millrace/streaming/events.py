"""Windows over an event stream: an extension, the same plan for tables and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per tumbling window. On a stream, events later than the watermark are dropped and a window is final once it has passed."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


def start_counts(spark: SparkSession, folder: str, schema: str, name: str, checkpoint: str) -> StreamingQuery:
    """Counts the Parquet files of a folder as a stream, into a table in memory, until all that is there was read."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return windowed_counts(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"))


QUERIES["x_event_windows"] = _daily
ORACLES["x_event_windows"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
