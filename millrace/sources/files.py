"""Readers and writers of files: typed Parquet, lines, delimited text, and the text forms of graphs and ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_source(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options: object) -> DataFrame:
    """A file or folder in any format of Spark's. How much of it a task reads is the session's setting (``session(max_partition_bytes=...)``)."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "|", header: bool = False) -> DataFrame:
    """Rows of text with a separator; a value that does not fit the schema is an error, not a made-up value."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, mode="FAILFAST", dateFormat="yyyy-MM-dd")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """``src dst`` lines without self loops."""
    ends = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).select(ends[0].cast("bigint").alias("src"), ends[1].cast("bigint").alias("dst")).where("src != dst")


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """``user::item::rating`` lines."""
    parts = F.split("value", "::")
    return lines(spark, path).select(parts[0].cast("bigint").alias("user"), parts[1].cast("bigint").alias("item"), parts[2].cast("double").alias("rating"))


def weighted_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """``node distance neighbour,weight:neighbour,weight:`` lines as (node, distance, src, dst, weight) edges; nodes without edges have nulls."""
    parts = F.split("value", " ")
    entry = F.explode_outer(F.filter(F.split(parts[2], ":"), lambda x: x != ""))
    flat = lines(spark, path).select(parts[0].cast("bigint").alias("node"), parts[1].cast("bigint").alias("distance"), entry.alias("entry"))
    pair = F.split("entry", ",")
    return flat.select("node", "distance", pair[0].cast("bigint").alias("dst"), pair[1].cast("bigint").alias("weight"))


def save(df: DataFrame, path: str, files: int | None = None, format: str = "parquet", keep_existing: bool = True) -> None:
    """Writes df, in so many files if given. What is there stays unless keep_existing is false."""
    (df.repartition(files) if files else df).write.mode("ignore" if keep_existing else "overwrite").format(format).save(path)
