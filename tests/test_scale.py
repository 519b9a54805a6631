"""Queries on tables whose results or intermediate rows would be too many if a plan spelled them out."""

import random

from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.operators.keyed import Keyed
from millrace.plans import registry, tpch


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hot_keys_are_counted_before_they_meet(spark, tmp_path):
    """1.8e10 and 4e10 pairs."""
    spark.range(200_000).selectExpr("cast(id % 3 as int) as l_linenumber", "id as l_orderkey", "id as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(200_000).selectExpr("cast(if(id % 10 = 0, null, id % 4) as int) as p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(200_000).selectExpr("cast(if(id < 10, null, 7) as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    skewed, same = (registry.QUERIES[q](spark, str(tmp_path)) for q in ("d3_skewed_join", "te2_supplier_self"))
    assert "Generate" not in _plan(skewed) and "Join" not in _plan(same)
    assert skewed.first()["n"] == 133_333 * 80_000 + 66_667 * 100_000
    assert same.first()["n"] == 199_990**2


def test_theta_join_in_cells(spark):
    """A hot key, ties at the ends of blocks, nulls and keys of one side only; a task has no more pairs than a few cells."""
    left = Keyed(spark.range(3000).selectExpr("if(id % 50 = 0, null, if(id < 2500, 1, id % 7)) as k", "id as a", "if(id % 31 = 0, null, cast(id % 40 as double)) as x"), ["k"])
    right = Keyed(spark.range(900).selectExpr("if(id < 700, 1, id % 9) as k", "id as b", "if(id % 29 = 0, null, cast(id % 37 as double)) as y"), ["k"])
    met = left.join_above(right, "x", "y", left_rows=100, right_rows=64).df
    want = left.df.join(right.df, "k").where("x > y")
    assert sorted(map(tuple, met.select("k", "a", "x", "b", "y").collect())) == sorted(map(tuple, want.select("k", "a", "x", "b", "y").collect()))
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 30 and max(sizes) <= 8 * 100 * 64 < sum(sizes)
    assert left.join_above(Keyed(right.df.where("b < 0"), ["k"]), "x", "y").df.count() == 0


def test_theta_query_cuts_its_work(spark, tmp_path):
    """80,000 customers of one nation are at most 2**15 a task; a plain join had as many tasks as files."""
    spark.range(80_000).selectExpr("id as c_custkey", "3 as c_nationkey", "cast(id as double) as c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(12).selectExpr("id as s_suppkey", "3 as s_nationkey", "cast(id as double) as s_acctbal").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = registry.QUERIES["d8_theta"](spark, str(tmp_path))
    rows = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == sum(80_000 - 2 * s - 1 for s in range(1, 12)) and len(rows) > 1


def test_closure_doubles_the_paths_of_the_core_only(spark, monkeypatch):
    """Trees of three layers over a ring, a node with two ways up, an edge to and from null: only the ring is left for rounds over all paths."""
    ring = [(i, (i + 1) % 4) for i in range(4)]
    rows = ring + [(i, i % 4) for i in range(10, 20)] + [(i, 10 + i % 10) for i in range(100, 150)] + [(i, 100 + i % 50) for i in range(1000, 1200)] + [(1000, 101), (1000, 3), (1001, None), (None, 10)]
    want = {r for r in rows}
    while more := {(a, d) for a, b in want if b is not None for c, d in rows if b == c} - want:
        want |= more
    seen, real = [], graph.fixpoint
    monkeypatch.setattr(graph, "fixpoint", lambda start, *rest: seen.append(start.count()) or real(start, *rest))
    got = [tuple(r) for r in graph.transitive_closure(spark.createDataFrame(rows, "src int, dst int")).collect()]
    assert len(got) == len(want) and set(got) == want
    assert seen == [4]


def test_triangles_of_a_random_graph(spark):
    """Hubs, repeats, loops, nulls and negative numbers; few wedges go on to the join."""
    draw = random.Random(5)
    rows = [(draw.randrange(-30, 30), draw.randrange(-30, 30)) for _ in range(400)] + [(1, i) for i in range(100, 400)] + [(2, i) for i in range(100, 400)] + [(None, 1), (3, None)]
    near = {}
    for a, b in rows:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = sum(len({c for c in near[a] & near[b] if c > b}) for a in near for b in near[a] if b > a)
    assert graph.triangles(spark.createDataFrame(rows, "src int, dst int")).first()[0] == want
    star = spark.createDataFrame([(i, j) for i in range(1000, 1400) for j in range(20)], "src int, dst int")
    assert "MapInArrow" in _plan(graph.triangles(star))
    assert graph.triangles(star).first()[0] == 0 and graph.triangles(star.limit(0)).first()[0] == 0


def test_wedges_are_all_pairs_of_a_list():
    stops = graph.np.array([3, 3, 4, 8])
    for most in (1, 4, 100):
        got = [(int(a), int(b)) for x, y in graph._wedges(stops, most) for a, b in zip(x, y, strict=True)]
        assert sorted(got) == sorted((a, b) for lo, hi in ((0, 3), (3, 3), (3, 4), (4, 8)) for a in range(lo, hi) for b in range(a + 1, hi))
    assert list(graph._wedges(graph.np.array([], dtype=int))) == []


def test_rounds_of_shortest_paths_do_not_shuffle_the_edges(spark, monkeypatch):
    plans, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    edges = spark.range(3000).selectExpr("id % 60 as src", "(id * 7 + id div 60) % 60 as dst", "id % 23 + 1 as weight")
    few = graph.shortest_paths(edges, 1)
    assert len(plans) > 1 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
    monkeypatch.setattr(graph, "_FRONT", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, graph.shortest_paths(edges, 1).collect()))


def test_q21_tasks_grow_in_number(spark, sf, monkeypatch):
    """Lines are shuffled and joined once, over tasks of so many lines."""
    want = [tuple(r) for r in registry.QUERIES["q21"](spark, sf).collect()]
    monkeypatch.setattr(tpch, "_LINES", 100)
    df = registry.QUERIES["q21"](spark, sf)
    tasks = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 2 == plan.count(f", {tasks}), ")
    assert [tuple(r) for r in df.collect()] == want
