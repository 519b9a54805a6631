"""Sharding by proportional stratified interleaving, with DataFrame operations alone.

Rows of each source (stratum) are put in a seeded order; the row of rank r among n has fractional rank (r + 1/2) / n. Rows
sorted by fractional rank interleave the sources in proportion, so that any run of consecutive rows has the mixture's
shares. The run is cut into shards whose counts differ by one at most.

No task holds a whole source and none the whole order: ranks are counted in slices of the hash (or of the fractional
rank, which is uniform by construction). The counts of the slices are summed up, and a row's rank is its slice's offset
plus its place in the slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import seeded, table, written

_HASHES = 1 << 52


def _ranked(rows: DataFrame, keys: list[str], slice_col: str, order: list[Column], name: str) -> DataFrame:
    """rows with ``name``: the rank from 0 among equal keys, by slice and then order. A slice's rows must be few; the slices' counts are summed."""
    sums = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, slice_col).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(sums), F.lit(0))).drop("__n")
    place = F.row_number().over(Window.partitionBy(*keys, slice_col).orderBy(*order))
    return rows.withColumn("__place", place).join(offsets, [*keys, slice_col]).withColumn(name, F.col("__before") + F.col("__place") - 1).drop("__before", "__place")


def interleaved_shards(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", slice_rows: int = 20_000) -> DataFrame:
    """One row per input row: id, source, size, text_crc32, shard, slot.

    Every shard holds each source in proportion; shard counts differ by one at most and slots are gapless from 0. A null
    source is a source of its own and a null text is empty. The order is a seeded hash of id and text, so that rows that repeat an id (or have none) spread. Its ties are ordered by id (null first),
    then by the text's checksum and size; rows equal in all of these are interchangeable. Other columns are not
    read. An empty table gives an empty result. ``slice_rows`` bounds how many rows a task must sort at once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).alias("id"),
            F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col))).alias("stratum"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            seeded(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.crc32(text.cast("binary"))), seed).alias("h"),
        ),
        "shard-rows",
    )
    total = rows.count()
    slices = max(1, -(-total // slice_rows))
    ties = [F.col("h"), F.col("id"), F.col("text_crc32"), F.col("size")]
    rows = rows.withColumn("slice", F.expr(f"cast(floor(h * {slices}D / {_HASHES}D) as bigint)"))
    rows = _ranked(rows, ["stratum"], "slice", ties, "r").drop("slice")
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, "stratum").withColumn("f", (2 * F.col("r") + 1).cast("double") / (2 * F.col("n")).cast("double"))
    rows = rows.withColumn("slice", F.expr(f"cast(floor(f * {slices}D) as bigint)")).withColumn("all", F.lit(0))
    rows = _ranked(rows, ["all"], "slice", [F.col("f"), F.col("stratum"), *ties], "p")
    q, rest = divmod(total, shards)
    long_rows = rest * (q + 1)  # those of the first shards, which hold a row more
    p = F.col("p")
    shard = F.when(p < long_rows, F.expr(f"p div {q + 1}")).otherwise(F.expr(f"{rest} + (p - {long_rows}) div {max(1, q)}")).cast("int")
    slot = F.when(p < long_rows, p % (q + 1)).otherwise((p - long_rows) % max(1, q))
    return rows.select(
        F.col("id").alias(id_col),
        F.when(F.col("stratum") != "", F.expr("substring(stratum, 2)")).alias(source_col),
        "size",
        "text_crc32",
        shard.alias("shard"),
        slot.cast("long").alias("slot"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is ``rows``: counts are one apart at most, so grown_shard is null."""
    out = interleaved_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum is folded over the text's bytes with the usual table, which is made from its polynomial.
OP6_SQL = """
WITH k AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
b AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)) AS bytes
  FROM documents),
r AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS stratum, octet_length(encode(text)) + 8 AS size,
         xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) || ':17'), 1, 13))::BIGINT AS h
  FROM b, k),
f AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS f
  FROM r),
p AS (
  SELECT *, row_number() OVER (ORDER BY f, stratum, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS p, count(*) OVER () // 24 AS q, count(*) OVER () % 24 AS rest
  FROM f)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law,
       (CASE WHEN p < rest * (q + 1) THEN p // (q + 1) ELSE rest + (p - rest * (q + 1)) // greatest(1, q) END)::INTEGER AS shard,
       (CASE WHEN p < rest * (q + 1) THEN p % (q + 1) ELSE (p - rest * (q + 1)) % greatest(1, q) END)::BIGINT AS slot,
       NULL::INTEGER AS grown_shard
FROM p
"""
