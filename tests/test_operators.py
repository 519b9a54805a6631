"""Small fixtures with results worked out by hand, and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import graph, iterate, numeric
from millrace.operators.dataset import Dataset, fraction_for, numbered
from millrace.operators.keyed import Keyed
from millrace.sources import files
from millrace.streaming import events


def test_join_keeps_matching_keys_only(spark):
    left = Keyed(spark.createDataFrame([(1, "A1"), (1, "A2"), (2, "B1"), (2, "B2"), (3, "C1"), (3, "C2")], "k int, a string"), ["k"])
    right = Keyed(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, "w")], "k int, b string"), ["k"])
    assert left.join(right).df.count() == 6
    assert right.anti(left).df.collect()[0]["k"] == 4
    full = {r["k"]: (r["left"], r["right"]) for r in left.cogroup(right, how="full").df.collect()}
    assert full[4] == ([], ["w"]) and full[1] == (["A1", "A2"], ["x"])


def test_zip_ends_with_the_shorter(spark):
    a, b = Dataset.range(spark, 0, 10, 3), Dataset(spark.range(100, 104).withColumnRenamed("id", "j"))
    assert sorted(map(tuple, a.zip(b, "id", "j").collect())) == [(0, 100), (1, 101), (2, 102), (3, 103)]


def test_numbered_is_gapless(spark):
    rows = numbered(spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")), "v", "n").collect()
    assert all(r["v"] == r["n"] for r in rows)


def test_sort_equals_local_sort(spark):
    rows = [((i * 7919) % 1009, i) for i in range(500)]
    got = Dataset(spark.createDataFrame(rows, "k int, v int")).sort_by(F.desc("k"), "v").collect()
    assert [tuple(r) for r in got] == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_sampling(spark):
    rows = Dataset.range(spark, 0, 5000)
    assert rows.take_sample(200, "id", seed=2).df.distinct().count() == 200
    assert Dataset.range(spark, 0, 5).take_sample(6, "id").df.count() == 5
    assert Dataset.range(spark, 0, 0).take_sample_with_replacement(3, "id").df.count() == 0
    assert 300 < rows.sample(0.1, seed=1).df.count() < 700
    assert fraction_for(500, 20_000) > 500 / 20_000
    assert sorted(r["id"] for r in rows.shuffle(3).collect()) == list(range(5000))


def test_fold_and_reduce_of_nothing(spark):
    none = Dataset.range(spark, 0, 0)
    assert none.reduce(s=F.sum("id")).first()["s"] is None
    assert none.fold(0, s=F.sum("id")).first()["s"] == 0


def test_cogroup_with_python(spark):
    a = Keyed(spark.createDataFrame([(1, 2), (1, 3)], "k int, a int"), ["k"])
    b = Keyed(spark.createDataFrame([(1, 10)], "k int, b int"), ["k"])

    def add(x, y):
        import pandas as pd

        return pd.DataFrame({"k": [1], "s": [int(x["a"].sum() + y["b"].sum())]})

    assert a.cogroup_py(b, add, "k int, s int").collect()[0]["s"] == 15


def test_shortest_paths(spark):
    edges = [(1, 2, 10), (1, 3, 5), (2, 3, 2), (2, 4, 1), (3, 2, 3), (3, 4, 9), (3, 5, 2), (4, 5, 4), (5, 1, 7), (5, 4, 6)]
    got = graph.shortest_paths(spark.createDataFrame(edges, "src int, dst int, weight int"), 1)
    assert {r["node"]: r["distance"] for r in got.collect()} == {1: 0, 2: 8, 3: 5, 4: 9, 5: 7}


def test_closure_of_a_cycle(spark):
    assert graph.transitive_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src int, dst int")).count() == 9


def test_shortest_paths_of_equal_distance(spark):
    """The least text stays, also where the path with more steps arrives later."""
    edges = [(1, 2, 1), (2, 3, 1), (3, 4, 1), (4, 9, 1), (1, 3, 2), (1, 4, 3), (1, 9, 4), (9, 5, 1), (7, 1, 1)]
    got = graph.shortest_paths(spark.createDataFrame(edges, "src int, dst int, weight int"), 1)
    assert {tuple(r) for r in got.collect()} == {(1, 0, "1"), (2, 1, "1>2"), (3, 2, "1>2>3"), (4, 3, "1>2>3>4"), (9, 4, "1>2>3>4>9"), (5, 5, "1>2>3>4>9>5")}


def test_shortest_paths_reach_far_nodes(spark):
    edges = spark.range(1, 30).selectExpr("id as src", "id + 1 as dst", "23 as weight")
    assert {r["node"]: r["distance"] for r in graph.shortest_paths(edges, 1).collect()} == {i + 1: 23 * i for i in range(30)}


def test_combiners_merge(spark):
    """A mean and a sorted top two as states, with null values, null keys and keys in many batches."""
    import heapq

    rows = [(None if i % 7 == 0 else i % 5, None if i % 11 == 0 else i * 37 % 1000) for i in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        two = lambda *v: heapq.nlargest(2, [x for x in v if x is not None]) + [None] * 2
        state = lambda n, v: (n, *two(*v)[:2])
        df = spark.createDataFrame(rows, "k int, v int").repartition(5)
        got = Keyed(df, ["k"]).combine_by_key_py(lambda v: state(1, [v]), lambda s, v: state(s[0] + 1, [*s[1:], v]), lambda s, t: state(s[0] + t[0], [*s[1:], *t[1:]]), "n long, a int, b int", "v").df
        want = {k: (sum(1 for x, _ in rows if x == k), *two(*(v for x, v in rows if x == k))[:2]) for k in {x for x, _ in rows}}
        assert {r["k"]: (r["n"], r["a"], r["b"]) for r in got.collect()} == want
        assert Keyed(df.limit(0), ["k"]).combine_by_key_py(lambda v: (1,), lambda s, v: (s[0] + 1,), lambda s, t: (s[0] + t[0],), "n long", "v").df.count() == 0
        total = Dataset(df).aggregate_py(lambda: (0, 0), lambda s, v: (s[0] + 1, s[1] + (v or 0)), lambda s, t: (s[0] + t[0], s[1] + t[1]), "n long, total long", "v")
        assert tuple(total.first()) == (3000, sum(v or 0 for _, v in rows))
        assert tuple(Dataset(df.limit(0)).aggregate_py(lambda: (0,), lambda s, v: (s[0] + 1,), lambda s, t: (s[0] + t[0],), "n long", "v").first()) == (0,)
        plan = got._jdf.queryExecution().toString()
        assert "collect_list" not in plan
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_samples_by_key_do_not_depend_on_partitions(spark):
    rows = spark.range(20_000)
    key = F.col("id")
    take = lambda parts: [sorted(r["id"] for r in x.collect()) for x in (Dataset(rows.repartition(parts)).sample(0.1, seed=3, key=key), Dataset(rows.repartition(parts)).sample(1.5, True, 3, key), *Dataset(rows.repartition(parts)).split(1, 2, seed=4, key=key))]
    once, again = take(2), take(7)
    assert once == again and 1800 < len(once[0]) < 2200 and 29_000 < len(once[1]) < 31_000
    assert sorted(once[2] + once[3]) == list(range(20_000)) and 6300 < len(once[2]) < 7000
    counts = [once[1].count(i) for i in once[1][:3000]]
    assert max(counts) > 3
    first, second = ([r["id"] for r in Dataset(rows.repartition(p)).shuffle(5, key).collect()] for p in (2, 5))
    assert first == second != sorted(first)


def test_dates_under_ansi(spark):
    got = spark.sql("select 2019 y, 2 m, 29 d").select(dates.make(F.col("y"), F.col("m"), F.col("d")).alias("t"), dates.is_valid(F.col("y"), F.col("m"), F.col("d")).alias("v")).first()
    assert tuple(got) == (None, False)


def test_shared_folder_is_an_error_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Cluster:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        iterate.shared_folder(Cluster())


def test_triangles_ignore_loops_and_repeats(spark):
    edges = [(1, 2), (2, 1), (2, 3), (3, 1), (3, 3), (3, 4)]
    assert graph.triangles(spark.createDataFrame(edges, "src int, dst int")).first()[0] == 1


def test_kmeans_equals_a_loop(spark):
    points = [[float(i % 7), float(i * i % 11)] for i in range(60)]
    centres, sizes = [p[:] for p in points[:3]], {}
    for _ in range(5):
        groups = {}
        for p in points:
            i = min(range(3), key=lambda c: ((p[0] - centres[c][0]) ** 2 + (p[1] - centres[c][1]) ** 2, c))
            groups.setdefault(i, []).append(p)
        new = [[sum(x) / len(x) for x in zip(*groups[i], strict=True)] if i in groups else centres[i] for i in range(3)]
        moved = sum(math.dist(a, b) for a, b in zip(centres, new, strict=True))
        centres, sizes = new, {i: len(g) for i, g in groups.items()}
        if moved <= 0.3:
            break
    df = spark.createDataFrame(list(enumerate(points)), "id int, x array<double>")
    got = sorted(numeric.kmeans(df, "id", k=3).collect())
    assert [r["size"] for r in got] == [sizes.get(i, 0) for i in range(3)]
    assert all(math.isclose(a, b) for r, c in zip(got, centres, strict=True) for a, b in zip(r["centre"], c, strict=True))


def test_text_forms(spark, tmp_path):
    (tmp_path / "r").write_text("1::2::3.5\n4::5::1\n")
    assert [tuple(r) for r in files.ratings(spark, str(tmp_path / "r")).collect()] == [(1, 2, 3.5), (4, 5, 1.0)]
    (tmp_path / "g").write_text("1 0 2,10:3,5:\n2 999 \n")
    assert [tuple(r) for r in files.weighted_adjacency(spark, str(tmp_path / "g")).collect()] == [(1, 0, 2, 10), (1, 0, 3, 5), (2, 999, None, None)]
    (tmp_path / "bad").write_text("x|y\n")
    with pytest.raises(Exception):  # noqa: B017
        files.delimited(spark, str(tmp_path / "bad"), "a int, b string").collect()


def test_stream_equals_table(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    q = events.start_counts(spark, str(tmp_path / "in"), fields, "event_counts", str(tmp_path / "checkpoint"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("event_counts").collect())) == sorted(map(tuple, events.windowed_counts(table).collect()))
