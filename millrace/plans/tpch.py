"""The 22 decision-support queries and three nation joins.

The parameters fit the tables at hand: orders start in 1995 and nations are numbered. Columns that the tables lack are derived
(``millrace.sources.tables``) where a query filters or joins by them and left out where it only shows them. Q13 and Q22 look at urgent
orders of 1996, since every customer has some order. Q16 takes suppliers in debt for those with complaints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import DERIVED_SQL, customer, lineitem, orders, part, partsupp, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Lines of q21 that a task takes.
_LINES = 1 << 20

_REV = "l_extendedprice * (1 - l_discount)"


def query(sql: str) -> Callable:
    """Registers the function by its name, and the SQL over the derived tables li, o, p, ps and c."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {DERIVED_SQL}\n{sql}"
        return f

    return add


def revenue() -> Column:
    return F.expr(_REV)


def total(expression: Column | str, name: str, digits: int = 4) -> Column:
    return F.round(F.sum(expression), digits).alias(name)


@query("SELECT count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def te1_supplier_customer(spark: SparkSession, d: str) -> DataFrame:
    """Counts per nation are multiplied, so the many-to-many join is never spelled out."""
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "k").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n"))


@query("SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
def te2_supplier_self(spark: SparkSession, d: str) -> DataFrame:
    """A self join of few, hot keys: by the square of each key's count."""
    n = table(spark, d, "supplier").where("s_nationkey is not null").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("n"))


@query("SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey")
def te3_customer_self(spark: SparkSession, d: str) -> DataFrame:
    """A self join of few, hot keys: by the square of each key's count."""
    n = table(spark, d, "customer").where("c_nationkey is not null").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("n"))


@query(f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum({_REV}), 4) AS sum_disc_price, round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
  round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM li WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL ORDER BY 1, 2""")
def q1(spark: SparkSession, d: str) -> DataFrame:
    rows = lineitem(spark, d).where("l_shipdate <= date_sub(date '1998-12-01', 90)")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        total("l_quantity", "sum_qty", 2), total("l_extendedprice", "sum_base_price", 2), total(revenue(), "sum_disc_price"), total(revenue() * (1 + F.col("l_tax")), "sum_charge", 2),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("count_order"),
    ).orderBy("l_returnflag", "l_linestatus")


@query("""SELECT s_acctbal, s_name, n_name, p_partkey FROM (
  SELECT s_acctbal, s_name, n_name, p_partkey, ps_supplycost, min(ps_supplycost) OVER (PARTITION BY p_partkey) AS least
  FROM p JOIN ps ON ps_partkey = p_partkey JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE p_type = 'PROMO' AND p_size = 15 AND r_name = 'EUROPE') WHERE ps_supplycost = least
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
def q2(spark: SparkSession, d: str) -> DataFrame:
    near = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = part(spark, d).where("p_type = 'PROMO' and p_size = 15").select("p_partkey")
    offers = partsupp(spark, d).join(wanted, F.col("ps_partkey") == F.col("p_partkey")).join(near, F.col("ps_suppkey") == F.col("s_suppkey"))
    offer = F.struct("s_acctbal", "s_name", "n_name")
    least = offers.groupBy("p_partkey", "ps_supplycost").agg(F.collect_list(offer).alias("offers")).groupBy("p_partkey").agg(F.min_by("offers", "ps_supplycost").alias("offers"))
    return least.select("p_partkey", F.inline("offers")).select("s_acctbal", "s_name", "n_name", "p_partkey").orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100)


@query(f"""SELECT l_orderkey, round(sum({_REV}), 4) AS revenue, o_orderdate::VARCHAR AS o_orderdate FROM c JOIN o ON o_custkey = c_custkey JOIN li ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1996-03-15' AND l_shipdate > DATE '1996-03-15'
GROUP BY l_orderkey, o.o_orderdate ORDER BY revenue DESC, o.o_orderdate, l_orderkey LIMIT 10""")
def q3(spark: SparkSession, d: str) -> DataFrame:
    buyers = customer(spark, d).where("c_mktsegment = 'BUILDING'").select("c_custkey")
    early = orders(spark, d).where("o_orderdate < date '1996-03-15'").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    late = lineitem(spark, d).where("l_shipdate > date '1996-03-15'")
    out = late.join(early, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(total(revenue(), "revenue"))
    return out.select("l_orderkey", "revenue", F.col("o_orderdate").cast("string").alias("o_orderdate")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10)


@query("""SELECT o_orderpriority, count(*) AS order_count FROM o WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
  AND EXISTS (SELECT 1 FROM li WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate) GROUP BY 1 ORDER BY 1""")
def q4(spark: SparkSession, d: str) -> DataFrame:
    asked = orders(spark, d).where("o_orderdate >= date '1996-07-01' and o_orderdate < add_months(date '1996-07-01', 3)")
    late = lineitem(spark, d).where("l_commitdate < l_receiptdate")
    return asked.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count")).orderBy("o_orderpriority")


@query(f"""SELECT n_name, round(sum({_REV}), 4) AS revenue FROM c JOIN o ON o_custkey = c_custkey JOIN li ON l_orderkey = o_orderkey
JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
WHERE r_name = 'ASIA' AND year(o_orderdate) = 1996 GROUP BY 1 ORDER BY 2 DESC, 1""")
def q5(spark: SparkSession, d: str) -> DataFrame:
    asia = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    sellers = table(spark, d, "supplier").join(asia, F.col("s_nationkey") == F.col("n_nationkey"))
    placed = orders(spark, d).where("o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01'").join(customer(spark, d).select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sold = lineitem(spark, d).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    local = sold.join(sellers, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return local.groupBy("n_name").agg(total(revenue(), "revenue")).orderBy(F.desc("revenue"), "n_name")


@query("""SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM li
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND round(l_discount, 2) BETWEEN 0.05e0 AND 0.07e0 AND l_quantity < 24""")
def q6(spark: SparkSession, d: str) -> DataFrame:
    rows = lineitem(spark, d).where("l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01' and round(l_discount, 2) between 0.05d and 0.07d and l_quantity < 24")
    return rows.agg(total(F.col("l_extendedprice") * F.col("l_discount"), "revenue"))


@query(f"""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, year(l_shipdate)::BIGINT AS l_year, round(sum({_REV}), 4) AS revenue
FROM li JOIN o ON o_orderkey = l_orderkey JOIN c ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
WHERE (a.n_name, b.n_name) IN (('NATION_3', 'NATION_8'), ('NATION_8', 'NATION_3')) AND year(l_shipdate) BETWEEN 1995 AND 1996 GROUP BY ALL ORDER BY 1, 2, 3""")
def q7(spark: SparkSession, d: str) -> DataFrame:
    two = table(spark, d, "nation").where("n_name in ('NATION_3', 'NATION_8')")
    sellers = table(spark, d, "supplier").join(two.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("supp_nation")), "s_nationkey")
    buyers = customer(spark, d).join(two.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("cust_nation")), "c_nationkey")
    shipped = lineitem(spark, d).where("l_shipdate >= date '1995-01-01' and l_shipdate <= date '1996-12-31'")
    bought = orders(spark, d).join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust_nation")
    both = shipped.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(bought, F.col("l_orderkey") == F.col("o_orderkey")).where("supp_nation != cust_nation")
    return both.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").cast("bigint").alias("l_year")).agg(total(revenue(), "revenue")).orderBy("supp_nation", "cust_nation", "l_year")


@query(f"""SELECT year(o_orderdate)::BIGINT AS o_year, round(sum(CASE WHEN s.n_name = 'NATION_8' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS mkt_share
FROM li JOIN o ON o_orderkey = l_orderkey JOIN c ON c_custkey = o_custkey JOIN p ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation s ON s.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey JOIN region ON r_regionkey = b.n_regionkey
WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY' AND year(o_orderdate) BETWEEN 1995 AND 1996 GROUP BY 1 ORDER BY 1""")
def q8(spark: SparkSession, d: str) -> DataFrame:
    here = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'AMERICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = customer(spark, d).join(here, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    placed = orders(spark, d).where("o_orderdate >= date '1995-01-01' and o_orderdate <= date '1996-12-31'").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    sellers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    sold = lineitem(spark, d).join(part(spark, d).where("p_type = 'ECONOMY'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(placed, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
    share = F.sum(F.when(F.col("n_name") == "NATION_8", revenue()).otherwise(0.0)) / F.sum(revenue())
    return sold.groupBy(F.year("o_orderdate").cast("bigint").alias("o_year")).agg(F.round(share, 6).alias("mkt_share")).orderBy("o_year")


@query(f"""SELECT n_name AS nation, year(o_orderdate)::BIGINT AS o_year, round(sum({_REV} - ps_supplycost * l_quantity), 4) AS sum_profit
FROM li JOIN p ON p_partkey = l_partkey JOIN ps ON ps_partkey = l_partkey AND ps_suppkey = l_suppkey JOIN supplier ON s_suppkey = l_suppkey
JOIN o ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = s_nationkey WHERE p_name LIKE '%blue%' GROUP BY ALL ORDER BY 1, 2 DESC""")
def q9(spark: SparkSession, d: str) -> DataFrame:
    blue = part(spark, d).where(F.col("p_name").contains("blue")).select("p_partkey")
    costs = partsupp(spark, d).join(blue, F.col("ps_partkey") == F.col("p_partkey"), "left_semi")
    sellers = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("nation"))
    sold = lineitem(spark, d).join(costs, (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey"))).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return sold.groupBy("nation", F.year("o_orderdate").cast("bigint").alias("o_year")).agg(total(revenue() - F.col("ps_supplycost") * F.col("l_quantity"), "sum_profit")).orderBy("nation", F.desc("o_year"))


@query(f"""SELECT c_custkey, c_name, round(sum({_REV}), 4) AS revenue, c_acctbal, n_name FROM c JOIN o ON o_custkey = c_custkey JOIN li ON l_orderkey = o_orderkey
JOIN nation ON n_nationkey = c_nationkey WHERE o_orderdate >= DATE '1995-10-01' AND o_orderdate < DATE '1996-01-01' AND l_returnflag = 'R'
GROUP BY ALL ORDER BY revenue DESC, c_custkey LIMIT 20""")
def q10(spark: SparkSession, d: str) -> DataFrame:
    placed = orders(spark, d).where("o_orderdate >= date '1995-10-01' and o_orderdate < date '1996-01-01'")
    lost = lineitem(spark, d).where("l_returnflag = 'R'").join(placed, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum(revenue()).alias("r"))
    named = lost.join(customer(spark, d), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select("c_custkey", "c_name", F.round("r", 4).alias("revenue"), "c_acctbal", "n_name").orderBy(F.desc("revenue"), "c_custkey").limit(20)


_STOCK = "FROM ps JOIN supplier ON s_suppkey = ps_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_8'"


@query(f"""SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS value {_STOCK} GROUP BY 1
HAVING sum(ps_supplycost * ps_availqty) > (SELECT 0.001e0 * sum(ps_supplycost * ps_availqty) {_STOCK}) ORDER BY 2 DESC, 1""")
def q11(spark: SparkSession, d: str) -> DataFrame:
    here = table(spark, d, "supplier").join(table(spark, d, "nation").where("n_name = 'NATION_8'"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    stock = partsupp(spark, d).join(here, F.col("ps_suppkey") == F.col("s_suppkey"), "left_semi").groupBy("ps_partkey").agg(F.sum(F.col("ps_supplycost") * F.col("ps_availqty")).alias("v"))
    least = stock.agg((F.sum("v") * 0.001).alias("least"))  # one row
    return stock.join(F.broadcast(least), F.col("v") > F.col("least")).select("ps_partkey", F.round("v", 2).alias("value")).orderBy(F.desc("value"), "ps_partkey")


@query("""SELECT l_shipmode, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high_line_count,
  sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END)::BIGINT AS low_line_count FROM o JOIN li ON l_orderkey = o_orderkey
WHERE l_shipmode IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate AND year(l_receiptdate) = 1996 GROUP BY 1 ORDER BY 1""")
def q12(spark: SparkSession, d: str) -> DataFrame:
    late = lineitem(spark, d).where("l_shipmode in ('MAIL', 'SHIP') and l_commitdate < l_receiptdate and l_shipdate < l_commitdate and l_receiptdate >= date '1996-01-01' and l_receiptdate < date '1997-01-01'")
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return late.join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_shipmode").agg(F.count_if(high).alias("high_line_count"), F.count_if(~high).alias("low_line_count")).orderBy("l_shipmode")


_URGENT = "o_orderpriority = '1-URGENT' and o_orderdate >= date '1996-01-01' and o_orderdate < date '1997-01-01'"


@query(f"""SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM c LEFT JOIN o ON o_custkey = c_custkey AND {_URGENT} GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 DESC""")
def q13(spark: SparkSession, d: str) -> DataFrame:
    counts = orders(spark, d).where(_URGENT).groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    each = customer(spark, d).join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.coalesce("n", F.lit(0)).alias("c_count"))
    return each.groupBy("c_count").agg(F.count(F.lit(1)).alias("custdist")).orderBy(F.desc("custdist"), F.desc("c_count"))


@query(f"""SELECT round(100 * sum(CASE WHEN p_type = 'PROMO' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS promo_revenue
FROM li JOIN p ON p_partkey = l_partkey WHERE l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""")
def q14(spark: SparkSession, d: str) -> DataFrame:
    sold = lineitem(spark, d).where("l_shipdate >= date '1996-09-01' and l_shipdate < date '1996-10-01'").join(part(spark, d), F.col("l_partkey") == F.col("p_partkey"))
    return sold.agg(F.round(100 * F.sum(F.when(F.col("p_type").startswith("PROMO"), revenue()).otherwise(0.0)) / F.sum(revenue()), 6).alias("promo_revenue"))


@query(f"""SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN (
  SELECT l_suppkey, round(sum({_REV}), 4) AS total_revenue, rank() OVER (ORDER BY round(sum({_REV}), 4) DESC) AS k FROM li
  WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY 1) ON l_suppkey = s_suppkey WHERE k = 1 ORDER BY 1""")
def q15(spark: SparkSession, d: str) -> DataFrame:
    sums = lineitem(spark, d).where("l_shipdate >= date '1996-01-01' and l_shipdate < date '1996-04-01'").groupBy("l_suppkey").agg(total(revenue(), "total_revenue"))
    best = sums.agg(F.max("total_revenue").alias("total_revenue"))  # one row
    return sums.join(F.broadcast(best), "total_revenue").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "total_revenue").orderBy("s_suppkey")


_SIZES = "49, 14, 23, 45, 19, 3, 36, 9"


@query(f"""SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN p ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#25' AND p_type <> 'MEDIUM' AND p_size IN ({_SIZES}) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY ALL ORDER BY 4 DESC, 1, 2, 3""")
def q16(spark: SparkSession, d: str) -> DataFrame:
    wanted = part(spark, d).where(f"p_brand != 'Brand#25' and not startswith(p_type, 'MEDIUM') and p_size in ({_SIZES})")
    offers = partsupp(spark, d).join(table(spark, d, "supplier").where("s_acctbal < 0"), F.col("ps_suppkey") == F.col("s_suppkey"), "left_anti")
    return offers.join(wanted, F.col("ps_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type", "p_size").agg(F.countDistinct("ps_suppkey").alias("supplier_cnt")).orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


@query("""SELECT round(sum(l_extendedprice) / 7, 2) AS avg_yearly FROM li JOIN p ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND p_container = 'MED BOX' AND l_quantity < (SELECT 0.2e0 * avg(x.l_quantity) FROM li x WHERE x.l_partkey = p_partkey)""")
def q17(spark: SparkSession, d: str) -> DataFrame:
    wanted = part(spark, d).where("p_brand = 'Brand#23' and p_container = 'MED BOX'").select("p_partkey")
    lines = lineitem(spark, d).join(wanted, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_partkey", "l_quantity", "l_extendedprice")
    least = lines.groupBy("l_partkey").agg((0.2 * F.avg("l_quantity")).alias("least"))
    return lines.join(least, "l_partkey").where("l_quantity < least").agg(F.round(F.sum("l_extendedprice") / 7, 2).alias("avg_yearly"))


@query("""SELECT c_name, c_custkey, o_orderkey, o_orderdate::VARCHAR AS o_orderdate, o_totalprice, sum(l_quantity) AS sum_qty FROM c JOIN o ON o_custkey = c_custkey JOIN li ON l_orderkey = o_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o.o_orderdate, o_totalprice HAVING sum(l_quantity) > 300 ORDER BY o_totalprice DESC, o.o_orderdate, o_orderkey LIMIT 100""")
def q18(spark: SparkSession, d: str) -> DataFrame:
    large = lineitem(spark, d).groupBy("l_orderkey").agg(F.sum("l_quantity").alias("sum_qty")).where("sum_qty > 300")
    named = large.join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey")).join(customer(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    return named.select("c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_totalprice", "sum_qty").orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey").limit(100)


_BLOCKS = " OR ".join(
    f"(p_brand = '{brand}' AND p_container IN ({boxes}) AND l_quantity BETWEEN {low} AND {low + 10} AND p_size BETWEEN 1 AND {size})"
    for brand, boxes, low, size in (("Brand#12", "'SM CASE', 'SM BOX'", 1, 5), ("Brand#23", "'MED BOX'", 10, 10), ("Brand#14", "'LG CASE', 'LG BOX'", 20, 15))
)


@query(f"SELECT round(sum({_REV}), 4) AS revenue FROM li JOIN p ON p_partkey = l_partkey WHERE l_shipmode IN ('AIR', 'AIR REG') AND ({_BLOCKS})")
def q19(spark: SparkSession, d: str) -> DataFrame:
    flown = lineitem(spark, d).where("l_shipmode in ('AIR', 'AIR REG') and l_quantity between 1 and 30")
    wanted = part(spark, d).where("p_brand in ('Brand#12', 'Brand#23', 'Brand#14') and p_size between 1 and 15")
    return flown.join(wanted, F.col("l_partkey") == F.col("p_partkey")).where(_BLOCKS).agg(total(revenue(), "revenue"))


@query("""SELECT s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_3' AND s_suppkey IN (
  SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM p WHERE p_name LIKE 'blue%') AND ps_availqty > (
    SELECT 0.5e0 * sum(l_quantity) FROM li WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND year(l_shipdate) = 1996)) ORDER BY 1""")
def q20(spark: SparkSession, d: str) -> DataFrame:
    sold = lineitem(spark, d).where("l_shipdate >= date '1996-01-01' and l_shipdate < date '1997-01-01'").groupBy("l_partkey", "l_suppkey").agg((0.5 * F.sum("l_quantity")).alias("half"))
    blue = part(spark, d).where(F.col("p_name").startswith("blue"))
    rich = partsupp(spark, d).join(blue, F.col("ps_partkey") == F.col("p_partkey"), "left_semi").join(sold, (F.col("ps_partkey") == F.col("l_partkey")) & (F.col("ps_suppkey") == F.col("l_suppkey"))).where("ps_availqty > half")
    here = table(spark, d, "supplier").join(table(spark, d, "nation").where("n_name = 'NATION_3'"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return here.join(rich, F.col("s_suppkey") == F.col("ps_suppkey"), "left_semi").select("s_name").orderBy("s_name")


@query("""SELECT s_name, count(*) AS numwait FROM supplier JOIN li a ON a.l_suppkey = s_suppkey JOIN o ON o_orderkey = a.l_orderkey JOIN nation ON n_nationkey = s_nationkey
WHERE o_orderstatus = 'F' AND n_name = 'NATION_3' AND a.l_receiptdate > a.l_commitdate
  AND EXISTS (SELECT 1 FROM li b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM li b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey AND b.l_receiptdate > b.l_commitdate)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""")
def q21(spark: SparkSession, d: str) -> DataFrame:
    """Both subqueries ask how many suppliers an order has, in all and late: one aggregate instead of two self joins.

    Of an order with one late supplier that aggregate also has the number of late lines, so lines are joined once. Tasks grow in number, not in size.
    """
    late = F.col("l_receiptdate") > F.col("l_commitdate")
    lines = lineitem(spark, d).where("l_orderkey is not null and l_suppkey is not null").select("l_orderkey", "l_suppkey", F.when(late, F.col("l_suppkey")).alias("late"))
    closed = orders(spark, d).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-table(spark, d, "lineitem").count() // _LINES))
    lines = lines.repartition(tasks, "l_orderkey").join(closed.repartition(tasks, "l_orderkey").hint("merge"), "l_orderkey", "left_semi")
    alone = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"), F.min("late").alias("la"), F.max("late").alias("lb"), F.count("late").alias("n")).where("a != b and la = lb")
    here = table(spark, d, "supplier").join(table(spark, d, "nation").where("n_name = 'NATION_3'"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    waits = alone.groupBy("la").agg(F.sum("n").alias("n")).join(here, F.col("la") == F.col("s_suppkey"))
    return waits.groupBy("s_name").agg(F.sum("n").alias("numwait")).orderBy(F.desc("numwait"), "s_name").limit(100)


_CODES = "'13', '31', '23', '29', '30', '18', '17'"


@query(f"""SELECT c_code AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM c
WHERE c_code IN ({_CODES}) AND c_acctbal > (SELECT avg(c_acctbal) FROM c WHERE c_acctbal > 0 AND c_code IN ({_CODES}))
  AND NOT EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey AND {_URGENT}) GROUP BY 1 ORDER BY 1""")
def q22(spark: SparkSession, d: str) -> DataFrame:
    there = customer(spark, d).where(f"c_code in ({_CODES})")
    mean = there.where("c_acctbal > 0").agg(F.avg("c_acctbal").alias("mean"))  # one row
    idle = there.join(F.broadcast(mean), F.col("c_acctbal") > F.col("mean")).join(orders(spark, d).where(_URGENT), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.groupBy(F.col("c_code").alias("cntrycode")).agg(F.count(F.lit(1)).alias("numcust"), total("c_acctbal", "totacctbal", 2)).orderBy("cntrycode")
