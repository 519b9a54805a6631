"""Matrices, correlation and iterative learning over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.iterate import cut


def multiply(a: DataFrame, b: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The product of two matrices of entries (i, j, v).

    If b has at most ``broadcast_rows`` entries, which are counted, it goes to the rows of a, whose sums then need no further shuffle.
    """
    rows = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    columns = cut(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")))
    if columns.limit(broadcast_rows + 1).count() <= broadcast_rows:
        rows, columns = rows.repartition("i"), F.broadcast(columns)
    return rows.join(columns, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))


def logistic_steps(points: DataFrame, start: list[float], rounds: int = 3) -> DataFrame:
    """(dim, w) after gradient steps of w -= sum x (1 / (1 + exp(-y w x)) - 1) y, each coordinate by itself; points are (x array, y)."""
    w = list(start)
    for _ in range(rounds):
        steps = [F.sum(F.col("x")[k] * (1 / (1 + F.exp(-F.col("y") * w[k] * F.col("x")[k])) - 1) * F.col("y")).alias(f"s{k}") for k in range(len(w))]
        gradient = points.agg(*steps).first()  # one number per dimension
        w = [a - (g or 0.0) for a, g in zip(w, gradient, strict=True)]
    return points.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(w)], "dim int, w double")


def _distance2(x: Column, centre: list[float]) -> Column:
    return sum((x[k] - float(c)) * (x[k] - float(c)) for k, c in enumerate(centre))


def kmeans(points: DataFrame, order: str, k: int = 10, dims: int = 2, epsilon: float = 0.3, max_rounds: int = 5) -> DataFrame:
    """(cluster, size, centre array) from the first k points in the given order; ends when the centres' moves add up to epsilon at most. A cluster that empties keeps its centre.

    points are (order, x array). The driver holds k centres.
    """
    points = cut(points.select(order, "x"))
    centres = [list(r["x"][:dims]) for r in points.orderBy(order).limit(k).collect()]
    sizes: dict[int, int] = {}
    for _ in range(max_rounds):
        nearest = F.array_min(F.array(*(F.struct(_distance2(F.col("x"), c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres))))["i"]
        means = points.groupBy(nearest.alias("i")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col("x")[j]).alias(f"m{j}") for j in range(dims))).collect()
        new = {r["i"]: [r[f"m{j}"] for j in range(dims)] for r in means}
        sizes = {r["i"]: r["n"] for r in means}
        moved = sum(sum((a - b) ** 2 for a, b in zip(c, new.get(i, c), strict=True)) ** 0.5 for i, c in enumerate(centres))
        centres = [new.get(i, c) for i, c in enumerate(centres)]
        if moved <= epsilon:
            break
    rows = [(i, sizes.get(i, 0), [float(v) for v in c]) for i, c in enumerate(centres)]
    return points.sparkSession.createDataFrame(rows, "cluster int, size long, centre array<double>")
