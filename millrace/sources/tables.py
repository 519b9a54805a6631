"""The tables of the star schema, and what the queries need that the files lack.

Derived columns and tables are functions of keys in integer arithmetic, so that any SQL engine gives the same values; ``DERIVED_SQL`` has them for
the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
SHIP_MODES = ["AIR", "AIR REG", "MAIL", "SHIP", "RAIL", "TRUCK", "FOB"]
CONTAINERS = ["SM BOX", "MED BOX", "LG BOX", "SM CASE", "LG CASE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _element(values: list[str], key: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with dates as DATE, and commit date, receipt date and ship mode derived from its keys."""
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").withColumns({
        "l_shipdate": day,
        "l_commitdate": F.date_add(day, (F.col("l_linenumber") % 5 - 2).cast("int")),
        "l_receiptdate": F.date_add(day, (F.col("l_orderkey") % 7 - F.col("l_partkey") % 3).cast("int")),
        "l_shipmode": _element(SHIP_MODES, "l_partkey"),
    })


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("p_container", _element(CONTAINERS, "p_partkey"))


def partsupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (part, supplier) pairs of lineitem with derived quantity and cost."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    return pairs.withColumns({
        "ps_availqty": 1 + (F.col("ps_partkey") * 31 + F.col("ps_suppkey") * 17) % 9999,
        "ps_supplycost": 1 + ((F.col("ps_partkey") * 7 + F.col("ps_suppkey") * 13) % 99900) / 100,
    })


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with the country code that its nation gives."""
    return table(spark, sf_dir, "customer").withColumn("c_code", (F.col("c_nationkey") + 10).cast("string"))


def _case(values: list[str], key: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({key} % {len(values)} + 1)::BIGINT)"


DERIVED_SQL = f"""
li AS (
  SELECT * REPLACE (l_shipdate::DATE AS l_shipdate),
         l_shipdate::DATE + (l_linenumber % 5 - 2)::INTEGER AS l_commitdate,
         l_shipdate::DATE + (l_orderkey % 7 - l_partkey % 3)::INTEGER AS l_receiptdate,
         {_case(SHIP_MODES, 'l_partkey')} AS l_shipmode
  FROM lineitem),
o AS (SELECT * REPLACE (o_orderdate::DATE AS o_orderdate) FROM orders),
p AS (SELECT *, {_case(CONTAINERS, 'p_partkey')} AS p_container FROM part),
ps AS (
  SELECT ps_partkey, ps_suppkey, 1 + (ps_partkey * 31 + ps_suppkey * 17) % 9999 AS ps_availqty,
         1 + ((ps_partkey * 7 + ps_suppkey * 13) % 99900)::DOUBLE / 100 AS ps_supplycost
  FROM (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)),
c AS (SELECT *, (c_nationkey + 10)::VARCHAR AS c_code FROM customer)"""
