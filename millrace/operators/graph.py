"""Graph algorithms over edge lists (src, dst)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.iterate import cut, fixpoint

_FRONT = 64 << 20  # bytes of changed nodes and their paths that a round of shortest_paths sends to every executor


def pagerank(edges: DataFrame, rounds: int = 1, damping: float = 0.85) -> DataFrame:
    """(node, rank) after so many rounds from rank 1. A node without links in has no rank and passes none on after the first round."""
    links = edges.select("src", "dst").distinct()
    links = cut(links.join(links.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src"))
    ranks = links.select(F.col("src").alias("node")).distinct().withColumn("rank", F.lit(1.0))
    for _ in range(rounds):
        given = links.join(ranks, links["src"] == ranks["node"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("sum"))
        ranks = cut(given.select("node", ((1 - damping) + damping * F.col("sum")).alias("rank")))
    return ranks


def transitive_closure(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All (src, dst) with a path, or with one of 2 ** max_rounds edges at most if max_rounds is given.

    Nodes without an edge in only begin paths: while they have half of the edges or more, they are set aside, layer by layer. The paths among the
    other nodes come by doubling their length each round. Each layer then takes one join with what its neighbours reach, and a node with one
    edge out needs no search for repeats.
    """
    now, layers = edges.select("src", "dst").distinct(), []
    while max_rounds is None:
        inner = now.select(F.col("dst").alias("node")).distinct()
        degree = F.count(F.lit(1)).over(Window.partitionBy("src")).alias("degree")
        marked = cut(now.join(inner, F.col("src") == F.col("node"), "left").select("src", "dst", F.col("node").isNull().alias("first"), degree))
        size = marked.agg(F.count(F.lit(1)).alias("all"), F.count_if("first").alias("first")).first()
        now = marked.where("not first").select("src", "dst")
        if not size["first"] or 2 * size["first"] < size["all"]:
            now = marked.select("src", "dst")
            break
        layers.append(marked.where("first").select("src", "dst", "degree"))

    def step(paths: DataFrame) -> DataFrame:
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        return paths.union(longer).distinct()

    reach = fixpoint(now, step, DataFrame.count, max_rounds)
    for layer in reversed(layers):
        ends = layer.select(F.col("dst").alias("mid"), F.col("dst").alias("end"))
        # An edge to null stays, but no path leads on from there.
        star = cut(reach.where("src is not null").select(F.col("src").alias("mid"), F.col("dst").alias("end")).union(ends).distinct())
        grown = lambda edges: edges.join(star, F.col("dst").eqNullSafe(F.col("mid"))).select("src", F.col("end").alias("dst"))  # noqa: B023, E731
        reach = cut(reach.union(grown(layer.where("degree = 1"))).union(grown(layer.where("degree > 1")).distinct()))
    return reach


def triangles(edges: DataFrame) -> DataFrame:
    """The number of triangles. Edges point from the node of smaller degree, which keeps the wedges of hubs few.

    A wedge is shuffled only if a bitmap of the edges that can close one may have its ends; the bitmap has 64 MB at most, and beyond its capacity lets more pass.
    """
    ends = edges.where("src != dst").select(F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).distinct()
    degree = ends.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ranked = ends.join(degree.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    low = F.least(F.struct("na", "a"), F.struct(F.col("nb").alias("na"), F.col("b").alias("a")))["a"]
    out = cut(ranked.select(low.alias("x"), F.when(low == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("y")))
    # The lower end of the edge that closes a wedge is itself the upper end of another.
    upper = out.select(F.col("y").alias("node")).distinct()
    close = cut(out.join(upper, F.col("x") == F.col("node"), "left_semi").select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z")))
    bits = min(29, max(16, (32 * close.count()).bit_length()))
    context = out.sparkSession.sparkContext
    bitmap = context.broadcast(_pair_bitmap(close, bits))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            nodes, stops = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            for first, second in _wedges(stops):
                y, z = nodes[first], nodes[second]
                slot = _slots(y, z, bits)
                hit = (bitmap.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
                yield pa.RecordBatch.from_arrays([pa.array(y[hit]), pa.array(z[hit])], ["y", "z"])

    wedge = out.groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("ys")).where("size(ys) > 1").select("ys").mapInArrow(met, "y long, z long")
    return wedge.join(close, ["y", "z"]).agg(F.count(F.lit(1)).alias("triangles"))


def _slots(y: np.ndarray, z: np.ndarray, bits: int) -> np.ndarray:
    """Where the bitmap has a pair: the upper bits of a mixed product."""
    h = y.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29)) ^ z.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _pair_bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits / 8 bytes of the slots of pairs (y, z), made of rows of 4 KB."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits))], ["slot"])

    rows = pairs.select("y", "z").mapInArrow(slots, "slot long").groupBy(F.expr("slot div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.toLocalIterator():
        out[r["bucket"] * 4096 : r["bucket"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _wedges(stops: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in the same list, for lists that end before stops: at most so many at a time, or those of one place."""
    starts = np.concatenate(([0], stops[:-1]))
    partners = np.repeat(stops, stops - starts) - 1 - np.arange(stops[-1] if len(stops) else 0)
    before = np.concatenate(([0], np.cumsum(partners)))
    i = 0
    while i < len(partners):
        j = max(i + 1, int(np.searchsorted(before, before[i] + most, "right")) - 1)
        first = np.repeat(np.arange(i, j), partners[i:j])
        yield first, first + 1 + np.arange(len(first)) - np.repeat(before[i:j] - before[i], partners[i:j])
        i = j


def shortest_paths(edges: DataFrame, source: int, max_rounds: int | None = None) -> DataFrame:
    """(node, distance, path) of all nodes that source reaches over edges (src, dst, weight), weights above 0. Of equal distances the least path as a text stays.

    Each round relaxes the edges of the nodes that changed in the round before; it ends when no distance and no path changes. A round reads edges
    once, so they should be a table or a checkpoint. It does not shuffle them as long as the changed nodes take less than _FRONT bytes.
    """
    at = "struct<distance:bigint,path:string>"
    now = edges.sparkSession.createDataFrame([(source, 0, str(source), True)], "node long, distance long, path string, changed boolean")
    links = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("weight").cast("long").alias("weight"))
    rounds, size = 0, 0
    while max_rounds is None or rounds < max_rounds:
        known = now.select("node", F.struct("distance", "path").alias("at"), F.struct("distance", "path").alias("old"))
        further = F.struct((F.col("distance") + F.col("weight")).alias("distance"), F.concat_ws(">", "path", F.col("dst").cast("string")).alias("path"))
        front = now.where("changed").select("node", "distance", "path")
        front = F.broadcast(front) if size < _FRONT else front
        moved = links.join(front, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(further).alias("at"))
        moved = moved.select(F.col("dst").alias("node"), "at", F.lit(None).cast(at).alias("old"))
        best = known.union(moved).groupBy("node").agg(F.min("at").alias("best"), F.min("old").alias("old"))
        now = cut(best.select("node", "best.distance", "best.path", (F.col("old").isNull() | (F.col("best") < F.col("old"))).alias("changed")))
        rounds += 1
        size = now.where("changed").agg(F.sum(F.length("path") + 64)).first()[0]
        if size is None:
            break
    return now.drop("changed")
