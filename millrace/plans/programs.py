"""Programs over collections: e-commerce and social-graph joins, micro programs, graphs, matrices and iterative learning.

Edges, orders, ratings and points are taken from the star schema: order items are lineitem, edges are (part, supplier) keys of lineitem,
ratings are (customer, part, quantity) and points are the first components of the embeddings. Graphs grow with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph, numeric
from millrace.operators.dataset import Dataset
from millrace.operators.keyed import Keyed
from millrace.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- e-commerce


@query("SELECT count(*) AS n FROM (SELECT l_partkey, sum(l_quantity) FROM lineitem GROUP BY 1)")
def bdb1_goods_sums(spark: SparkSession, d: str) -> DataFrame:
    return Keyed(table(spark, d, "lineitem"), ["l_partkey"]).reduce_by_key(goods=F.sum("l_quantity")).df.agg(F.count("goods").alias("n"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_extendedprice > 50000")
def bdb2_large_amounts(spark: SparkSession, d: str) -> DataFrame:
    return Dataset(table(spark, d, "lineitem")).filter("l_extendedprice > 50000").df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def bdb3_items_orders(spark: SparkSession, d: str) -> DataFrame:
    items = Keyed(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])
    return items.join(Keyed(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), ["k"])).df.agg(F.count(F.lit(1)).alias("n"))


# --- social graph: users by how many edges leave and reach them

_FEW, _MANY = 20, 30
_EDGES_SQL = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey)"
_PARTS_SQL = f"""WITH {_EDGES_SQL}, o AS (SELECT src, count(*) AS n FROM e GROUP BY 1),
popular AS (SELECT e.* FROM e JOIN o USING (src) WHERE n >= {_MANY}), inactive AS (SELECT e.* FROM e JOIN o USING (src) WHERE n <= {_FEW}),
normal AS (SELECT e.* FROM e JOIN o USING (src) WHERE n > {_FEW} AND n < {_MANY})"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Who follows whom: every pair of part and supplier number in lineitem, as numbers of users. The graph grows with the table."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).where("src != dst").distinct()


def _social(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _edges(spark, d)
    known = e.join(e.groupBy("src").agg(F.count(F.lit(1)).alias("n")), "src")
    return known.where(f"n >= {_MANY}"), known.where(f"n <= {_FEW}"), known.where(f"n > {_FEW} and n < {_MANY}")


def _paths(a: DataFrame, b: DataFrame, left: str, right: str) -> DataFrame:
    """The number of pairs that meet, from the counts per node."""
    x = a.groupBy(F.col(left).alias("k")).agg(F.count(F.lit(1)).alias("x"))
    y = b.groupBy(F.col(right).alias("k")).agg(F.count(F.lit(1)).alias("y"))
    return x.join(y, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("n"))


@query(f"{_PARTS_SQL} SELECT count(*) AS n FROM popular a JOIN inactive b ON a.dst = b.src")
def se1_popular_inactive(spark: SparkSession, d: str) -> DataFrame:
    popular, inactive, _ = _social(spark, d)
    return _paths(popular, inactive, "dst", "src")


@query(f"{_PARTS_SQL} SELECT count(*) AS n FROM popular a JOIN normal b ON a.dst = b.src")
def se2_popular_normal(spark: SparkSession, d: str) -> DataFrame:
    popular, _, normal = _social(spark, d)
    return _paths(popular, normal, "dst", "src")


@query(f"{_PARTS_SQL} SELECT count(*) AS n FROM popular a JOIN normal b ON a.src = b.dst")
def se3_popular_sources(spark: SparkSession, d: str) -> DataFrame:
    popular, _, normal = _social(spark, d)
    return _paths(popular, normal, "src", "dst")


# --- graphs, matrices and learning


@query("""WITH l AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey),
g AS (SELECT src, count(*) AS n FROM l GROUP BY 1),
r1 AS (SELECT dst AS node, 0.15e0 + 0.85e0 * sum(1.0e0 / n) AS rank FROM l JOIN g USING (src) GROUP BY 1),
r2 AS (SELECT dst AS node, 0.15e0 + 0.85e0 * sum(rank / n) AS rank FROM l JOIN g USING (src) JOIN r1 ON r1.node = l.src GROUP BY 1)
SELECT node, round(rank, 6) AS rank FROM r2""")
def pr_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_edges(spark, d), rounds=2).select("node", F.round("rank", 6).alias("rank"))


@query("""WITH RECURSIVE e AS (SELECT o_orderkey * 4 AS src, o_custkey * 4 + 1 AS dst FROM orders UNION SELECT c_custkey * 4 + 1, c_nationkey * 4 + 2 FROM customer
  UNION SELECT n_nationkey * 4 + 2, n_regionkey * 4 + 3 FROM nation UNION SELECT r_regionkey * 4 + 3, ((r_regionkey + 1) % (SELECT count(*) FROM region)) * 4 + 3 FROM region),
p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src) SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM p""")
def tc_transitive_closure(spark: SparkSession, d: str) -> DataFrame:
    """From orders to customers, nations and regions, which form a ring: all of four tables, in a graph that grows with them."""
    link = lambda name, src, dst: table(spark, d, name).selectExpr(f"cast({src} as long) as src", f"cast({dst} as long) as dst")
    regions = table(spark, d, "region").agg(F.count(F.lit(1)).alias("n"))
    ring = table(spark, d, "region").crossJoin(F.broadcast(regions)).selectExpr("cast(r_regionkey * 4 + 3 as long) as src", "cast(((r_regionkey + 1) % n) * 4 + 3 as long) as dst")
    up = link("orders", "o_orderkey * 4", "o_custkey * 4 + 1").union(link("customer", "c_custkey * 4 + 1", "c_nationkey * 4 + 2"))
    return graph.transitive_closure(up.union(link("nation", "n_nationkey * 4 + 2", "n_regionkey * 4 + 3")).union(ring))


@query("""WITH e AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey)
SELECT count(*) AS triangles FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b""")
def tri_triangles(spark: SparkSession, d: str) -> DataFrame:
    return graph.triangles(table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))


@query("""WITH RECURSIVE w AS MATERIALIZED (SELECT l_partkey AS src, l_suppkey AS dst, min(1 + (l_partkey * 7 + l_suppkey * 3) % 23) AS weight FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2),
p(node, distance, path) USING KEY (node) AS (SELECT 1::BIGINT, 0::BIGINT, '1' UNION
  SELECT n.dst, n.best.d, n.best.p FROM (SELECT w.dst::BIGINT AS dst, min({'d': p.distance + w.weight, 'p': p.path || '>' || w.dst}) AS best FROM p JOIN w ON p.node = w.src GROUP BY 1) n
  LEFT JOIN recurring.p r ON r.node = n.dst WHERE r.node IS NULL OR n.best < {'d': r.distance, 'p': r.path})
SELECT node, distance, path FROM p""")
def dij_shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Distance and path of all nodes that node 1 reaches."""
    weight = (1 + (F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 23).alias("weight")
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), weight).where("src != dst")
    return graph.shortest_paths(links, 1)


@query("""WITH a AS (SELECT l_orderkey % 2000 AS i, l_suppkey % 20 AS j, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey % 20 AS i, l_partkey % 2000 AS j, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2),
c AS (SELECT a.i, b.j, sum(a.v * b.v)::BIGINT AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2)
SELECT count(*) AS entries, sum(v)::DECIMAL(38,0) AS total, sum(v * ((i * 31 + j) % 97))::DECIMAL(38,0) AS weighed, max(v) AS most FROM c""")
def mm_matrix_product(spark: SparkSession, d: str) -> DataFrame:
    """Matrices of 2000 x 20 and 20 x 2000; the product's entries are counted and summed in two ways."""
    l = table(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))  # noqa: E741
    a = l.groupBy((F.col("l_orderkey") % 2000).alias("i"), (F.col("l_suppkey") % 20).alias("j")).agg(F.sum("q").alias("v"))
    b = l.groupBy((F.col("l_suppkey") % 20).alias("i"), (F.col("l_partkey") % 2000).alias("j")).agg(F.sum("q").alias("v"))
    weighed = F.sum((F.col("v") * ((F.col("i") * 31 + F.col("j")) % 97)).cast("decimal(28,0)")).alias("weighed")
    return numeric.multiply(a, b).agg(F.count("v").alias("entries"), F.sum(F.col("v").cast("decimal(28,0)")).alias("total"), weighed, F.max("v").alias("most"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS r FROM lineitem")
def pe_pearson(spark: SparkSession, d: str) -> DataFrame:
    return numeric.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("r", 9).alias("r"))


def _lr_step(source: str, k: int) -> str:
    return f"(SELECT {source} - sum(x{k} * (1 / (1 + exp(-y * {source} * x{k})) - 1) * y) FROM t)"


_LR = "WITH t AS (SELECT embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, CASE WHEN label % 2 = 0 THEN 1.0e0 ELSE -1.0e0 END AS y FROM embeddings)"
_LR += ", w1 AS (SELECT " + _lr_step("0.5e0", 0) + " AS a, " + _lr_step("(-0.5e0)", 1) + " AS b)"
for _i in (2, 3):
    _LR += f", w{_i} AS (SELECT a - (SELECT sum(x0 * (1 / (1 + exp(-y * a * x0)) - 1) * y) FROM t) AS a, b - (SELECT sum(x1 * (1 / (1 + exp(-y * b * x1)) - 1) * y) FROM t) AS b FROM w{_i - 1})"


@query(_LR + " SELECT 0 AS dim, round(a, 6) AS w FROM w3 UNION ALL SELECT 1, round(b, 6) FROM w3")
def lr_logistic_steps(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 2), lambda v: v.cast("double"))
    points = table(spark, d, "embeddings").select(x.alias("x"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0).alias("y"))
    return numeric.logistic_steps(points, [0.5, -0.5], 3).select("dim", F.round("w", 6).alias("w"))


def _km(k: int = 10, dims: int = 5, rounds: int = 5, epsilon: float = 0.3) -> str:
    """The rounds spelled out: the nearest centre of each point, the means, and whether they still moved."""
    far = " + ".join(f"(x[{j}] - c.c[{j}]) ** 2" for j in range(1, dims + 1))
    out = f"""WITH t AS (SELECT vec_id, list_transform(embedding[1:{dims}], lambda v: v::DOUBLE) AS x FROM embeddings),
c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, x AS c, 0::BIGINT AS n, false AS done FROM t ORDER BY vec_id LIMIT {k})"""
    for r in range(1, rounds + 1):
        out += f""",
a{r} AS (SELECT vec_id, any_value(x) AS x, arg_min(c.i, ({far}, c.i)) AS i FROM t, c{r - 1} c GROUP BY vec_id),
m{r} AS (SELECT i, count(*) AS n, [{", ".join(f"avg(x[{j}])" for j in range(1, dims + 1))}] AS c FROM a{r} GROUP BY i),
s{r} AS (SELECT sum(CASE WHEN m.i IS NULL THEN 0 ELSE sqrt({" + ".join(f"(m.c[{j}] - c.c[{j}]) ** 2" for j in range(1, dims + 1))}) END) <= {epsilon} AS still FROM c{r - 1} c LEFT JOIN m{r} m USING (i)),
c{r} AS (SELECT c.i, CASE WHEN c.done THEN c.c ELSE coalesce(m.c, c.c) END AS c, CASE WHEN c.done THEN c.n ELSE coalesce(m.n, 0) END AS n, c.done OR s.still AS done FROM c{r - 1} c LEFT JOIN m{r} m USING (i), s{r} s)"""
    return out + f" SELECT i::INTEGER AS cluster, n::BIGINT AS size, {', '.join(f'round(c[{j}], 6) AS x{j}' for j in range(1, dims + 1))} FROM c{rounds}"


@query(_km())
def km_kmeans(spark: SparkSession, d: str) -> DataFrame:
    x = F.transform(F.slice("embedding", 1, 5), lambda v: v.cast("double"))
    out = numeric.kmeans(table(spark, d, "embeddings").select("vec_id", x.alias("x")), "vec_id", k=10, dims=5)
    return out.select("cluster", "size", *(F.round(F.col("centre")[j], 6).alias(f"x{j + 1}") for j in range(5)))


@query("SELECT l_partkey AS item, floor(avg(l_quantity))::BIGINT AS mean FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topk_mean_rating(spark: SparkSession, d: str) -> DataFrame:
    rated = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    means = Keyed(rated, ["l_partkey"]).reduce_by_key(mean=F.floor(F.avg("l_quantity"))).df
    return Dataset(means.select(F.col("l_partkey").alias("item"), "mean")).top(10, F.col("mean"), "item").df


# --- micro programs


@query("SELECT count(*) AS n, sum(i % 1048576 * 4399 // (i % 71 + 1))::BIGINT AS total FROM range(10000000) t(i)")
def m1_map(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(10_000_000).selectExpr("id % 1048576 * 4399 div (id % 71 + 1) as v").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


@query("SELECT 2000000::BIGINT AS n")
def m2_filter(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.range(spark, 0, 10_000_000).filter("id % 5 = 0").df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT k, array_to_string(list_sort(list(v)), ',') AS vs FROM (SELECT 'x' AS k, unnest(range(1, 8)) AS v UNION ALL SELECT 'y', unnest(range(1, 9))) GROUP BY 1")
def m3_group_by(spark: SparkSession, d: str) -> DataFrame:
    rows = [("x", v) for v in range(1, 8)] + [("y", v) for v in range(1, 9)]
    grouped = Keyed(Dataset.of(spark, rows, "k string, v long").df, ["k"]).group_by_key("vs").df
    return grouped.select("k", F.array_join(F.col("vs").cast("array<string>"), ",").alias("vs"))


@query("SELECT i % 1000 AS k, count(*) AS n, sum(i)::BIGINT AS total, min(i) AS least FROM range(1000000) t(i) GROUP BY 1")
def m3_group_by_large(spark: SparkSession, d: str) -> DataFrame:
    """A million pairs in a thousand groups, each of which is an array."""
    grouped = Keyed(spark.range(1_000_000).selectExpr("id % 1000 as k", "id as v"), ["k"]).group_by_key("vs").df
    return grouped.select("k", F.size("vs").cast("long").alias("n"), F.aggregate("vs", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_min("vs").alias("least"))


@query("SELECT count(*) AS n FROM range(10000) a(i) JOIN range(10000) b(j) ON i % 100 = j % 100")
def m4_join(spark: SparkSession, d: str) -> DataFrame:
    a = Keyed(spark.range(10_000).selectExpr("id % 100 as k", "id as a"), ["k"])
    return a.join(Keyed(spark.range(10_000).selectExpr("id % 100 as k", "id as b"), ["k"])).df.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 1::BIGINT AS v")
def m5_distinct(spark: SparkSession, d: str) -> DataFrame:
    return Dataset(spark.range(100).select(F.lit(1).cast("bigint").alias("v"))).distinct().df


@query("SELECT count(DISTINCT w) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)")
def m6_distinct_words(spark: SparkSession, d: str) -> DataFrame:
    return Dataset(table(spark, d, "documents")).flat_map(F.split("text", " "), "w").distinct().df.agg(F.count("w").alias("n"))


@query("SELECT 200::BIGINT AS many, 5::BIGINT AS few")
def m7_take_sample(spark: SparkSession, d: str) -> DataFrame:
    many, few = (Dataset.range(spark, 0, n).take_sample(k, "id", seed=1).df.agg(F.count(F.lit(1)).alias(name)) for n, k, name in ((10_000, 200, "many"), (5, 6, "few")))
    return many.crossJoin(few)


@query("SELECT i AS id FROM range(10) t(i)")
def m8_take(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.range(spark, 0, 100_000).take(10, "id").df


@query("SELECT 45::BIGINT AS total")
def m9_reduce(spark: SparkSession, d: str) -> DataFrame:
    return Dataset.range(spark, 0, 10).reduce(total=F.sum("id"))


@query("SELECT 500000::BIGINT AS first, 500000::BIGINT AS second")
def m10_count(spark: SparkSession, d: str) -> DataFrame:
    kept = Dataset(spark.range(500_000).selectExpr("id * 2 as v")).cache()
    counts = [kept.count().first()[0] for _ in range(2)]
    kept.uncache()
    return spark.createDataFrame([tuple(counts)], "first long, second long")


@query("SELECT * FROM (VALUES (1::BIGINT, '5a'), (2, '4b'), (3, '3c'), (4, '2d'), (5, '1a')) t(a, b)")
def m11_zip(spark: SparkSession, d: str) -> DataFrame:
    a = Dataset.of(spark, [(i,) for i in range(1, 6)], "a long")
    b = Dataset.of(spark, list(enumerate(["5a", "4b", "3c", "2d", "1a"])), "place int, b string")
    return Dataset(a.zip(b, "a", "place").df.select("a", "b")).df


@query("SELECT (i * 7919) % 1000003 AS k, i AS v FROM range(1000000) t(i) ORDER BY 1, 2")
def m12_sort_by(spark: SparkSession, d: str) -> DataFrame:
    return Dataset(spark.range(1_000_000).selectExpr("(id * 7919) % 1000003 as k", "id as v")).sort_by("k", "v").df
