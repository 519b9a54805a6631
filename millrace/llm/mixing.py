"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source is wanted target / size times: a whole number of copies, the same for all, and a fraction that
is its inclusion probability for one more. The flight phase moves the probabilities of three documents at a time along
the null space of the two constraints (documents and words of the source) until one of them is 0 or 1, so that both
totals stay what they were. Two undecided documents remain at most.

A source is flown in slices of bounded size. What a slice leaves undecided is gathered, two documents a slice, and flown again,
until a source fits one group. That group also holds a reserve of documents set apart before. In the landing phase
the last two documents are decided, and a few documents of that group are exchanged, so that the words come as near the
target as those allow and the documents stay balanced. A source so small that this leaves more than a hundredth of its target gets single
documents of that group once more or less often, within the cap.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import discard, seeded, table, written

_SPAN = float(1 << 52)
_EPS = 1e-9
_FLOWN = "row long, source string, size long, h long, whole int, pi double"


def flight(pi: list[float], size: list[int], draws: list[float]) -> list[int]:
    """Decides pi in place, in order, with the totals of pi and pi * size kept; returns the places of the two left at most."""
    todo = iter([i for i, p in enumerate(pi) if _EPS < p < 1 - _EPS])
    for i, p in enumerate(pi):
        if not _EPS < p < 1 - _EPS:
            pi[i] = float(round(p))
    open_: list[int] = []
    draw = iter(draws)
    while True:
        while len(open_) < 3 and (i := next(todo, None)) is not None:
            open_.append(i)
        if len(open_) < 3:
            return open_
        a, b, c = (size[i] for i in open_)
        u = (c - b, a - c, b - a)
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - pi[i]) / x if x > 0 else -pi[i] / x for i, x in zip(open_, u, strict=True) if x)
        down = min(pi[i] / x if x > 0 else (pi[i] - 1) / x for i, x in zip(open_, u, strict=True) if x)
        step = up if next(draw) * (up + down) < down else -down
        for i, x in zip(open_, u, strict=True):
            pi[i] += step * x
        settled = [i for i in open_ if not _EPS < pi[i] < 1 - _EPS]
        if not settled:  # rounding: the one nearest to an end is there
            settled = [min(open_, key=lambda i: min(pi[i], 1 - pi[i]))]
        for i in settled:
            pi[i] = float(round(pi[i]))
            open_.remove(i)


def _nearest(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x, the place of the nearest of the sorted values."""
    at = np.clip(np.searchsorted(values, x), 0, len(values) - 1)
    lower = np.maximum(at - 1, 0)
    return np.where(np.abs(values[lower] - x) <= np.abs(values[at] - x), lower, at)


def land(pi: list[float], size: list[int], left: list[int], words: float, exchanges: int = 8) -> None:
    """Decides the places left, then exchanges rows while that brings the words selected nearer to ``words``.

    An exchange swaps a selected row for another; where no swap helps, it adds or drops one row, so that the documents stay
    within two of their total.
    """
    wanted = sum(pi)
    options = []
    for n in range(1 << len(left)):
        chosen = [i for k, i in enumerate(left) if n >> k & 1]
        if abs(len(chosen) - sum(pi[i] for i in left)) < 1 + _EPS:
            options.append((abs(sum(size[i] for i in chosen) - sum(size[i] * pi[i] for i in left)), n))
    for k, i in enumerate(left):
        pi[i] = float(min(options)[1] >> k & 1)
    error, count = float(np.dot(pi, size)) - words, sum(pi) - wanted
    order = sorted(range(len(pi)), key=lambda i: (size[i], i))
    for _ in range(exchanges):
        inside, out = [i for i in order if pi[i] == 1], [i for i in order if pi[i] == 0]
        in_sizes, out_sizes = np.array([size[i] for i in inside], dtype=float), np.array([size[i] for i in out], dtype=float)
        found = [(abs(error), 0, None, None)]
        if inside and out:
            partner = _nearest(in_sizes, out_sizes + error)
            k = int(np.argmin(np.abs(error + out_sizes - in_sizes[partner])))
            found.append((abs(error + size[out[k]] - size[inside[partner[k]]]), 1, out[k], inside[partner[k]]))
        if out and count < 1:
            k = out[_nearest(out_sizes, np.array([-error]))[0]]
            found.append((abs(error + size[k]), 2, k, None))
        if inside and count > -1:
            k = inside[_nearest(in_sizes, np.array([error]))[0]]
            found.append((abs(error - size[k]), 2, None, k))
        _, kind, add, drop = min(found, key=lambda o: (round(o[0], 6), o[1]))
        if not kind:
            return
        for i, to in ((add, 1.0), (drop, 0.0)):
            if i is not None:
                error, count = error + (2 * to - 1) * size[i], count + (2 * to - 1)
                pi[i] = to


def top_up(pi: list[float], size: list[int], least: int, most: int, words: float, steps: int = 1000) -> None:
    """Where more than a hundredth of ``words`` is still missing or too much, single rows go one up or down, between least and most: always the one that brings the sum nearest."""
    p, n = np.array(pi), np.array(size, dtype=float)
    error = float(p @ n) - words
    for _ in range(steps):
        if abs(error) <= 0.01 * words or not len(p):
            break
        can = (p < most) if error < 0 else (p > least)
        after = np.where(can, np.abs(np.abs(error) - n), np.inf)
        k = int(np.argmin(after))
        if after[k] >= abs(error):
            break
        step = 1 if error < 0 else -1
        p[k], error = p[k] + step, error + step * n[k]
    pi[:] = p.tolist()


def _flown(seed: int, stage: int, cap: int | None = None):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "size", "row"], kind="stable", ignore_index=True)
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(repr((seed, stage, *map(str, key))).encode()).digest()[:16], "big"))
        pi, size = rows["pi"].tolist(), rows["size"].tolist()
        words = float(np.dot(rows["pi"], rows["size"]))
        left = flight(pi, size, rng.random(len(pi) + 1).tolist())
        if cap is not None and len(rows):
            whole = int(rows["whole"].iloc[0])
            land(pi, size, left, words)
            top_up(pi, size, -whole, cap - whole, words)
        return rows.assign(pi=pi)[["row", "source", "size", "h", "whole", "pi"]]

    return run


def fill_targets(sources: DataFrame, cap: int) -> DataFrame:
    """sources (source, size, n) with target: they share 100 % of all sizes by weight 1, 2, 3, repeating, over the sources by code point, null last;
    none exceeds cap times its size, and the excess is shared anew among the others.

    Places are counted in the ranges of a sort, so that there may be any number of sources. The driver only sees sums.
    """
    ordered = written(sources.orderBy(F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) + F.col("before") - 1
    weighed = written(ordered.join(F.broadcast(offsets), "part").select("source", "size", "n", (place % 3 + 1).alias("weight")), "mix-weights")
    discard(ordered)
    total = weighed.agg(F.sum("size")).first()[0] or 0
    limit, level = F.col("size") * cap, 0.0  # what a source takes for each unit of weight
    while True:
        free = F.col("weight") * level <= limit
        weights, taken = weighed.agg(F.sum(F.when(free, F.col("weight"))), F.sum(F.when(~free, limit))).first()
        new = (total - (taken or 0)) / weights if weights else level
        if new <= level:
            break
        level = new
    return weighed.withColumn("target", F.least(F.col("weight") * level, limit.cast("double"))).drop("weight")


def mix(docs: DataFrame, seed: int = 23, cap: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", group_rows: int = 20_000, reserve: int = 500) -> DataFrame:
    """One row per input row: id, text_key, source, size, source_size, target, copies, taken.

    size is the number of words (runs of other than white space; null: 0). Targets are those of ``fill_targets``; copies is a
    whole number of at most ``cap``, and taken = size * copies. A null source is a source of its own. Empty texts
    count as documents of size 0. Rows that repeat an id are documents of their own; text_key, the MD5 of the text, tells them apart. Reruns agree: all draws
    are seeded by source and slice, and rows are ordered by a hash of id and text. Other columns are not read; an empty table
    gives an empty result. A task holds about ``group_rows`` rows of numbers and sizes; only rows of one source that repeat both id and text are
    never parted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text.alias("text")).withColumn("key", F.md5("text"))
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size")
    by = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("key"))
    rows = written(keyed.select(F.monotonically_increasing_id().alias("row"), "id", F.unhex("key").alias("text_key"), "source", size, seeded(by, seed).alias("h")), "mix-rows")
    known = fill_targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), cap)
    wanted = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    known = known.withColumn("wanted", wanted).withColumn("whole", F.floor(F.col("wanted") + _EPS)).withColumn("rest", F.col("wanted") - F.col("whole"))
    slices = F.when(F.col("n") <= group_rows, 0).otherwise(F.ceil(F.col("n") / group_rows))
    known = written(
        known.select(
            F.col("source").alias("of"), F.col("size").alias("source_size"), "target", F.col("whole").cast("int").alias("whole"),
            F.when(F.col("rest") > _EPS, F.col("rest")).otherwise(0.0).alias("share"), slices.cast("int").alias("slices"), (reserve / F.col("n")).alias("reserved"),
        ),
        "mix-targets",
    )
    # Broadcast by Spark if the table of sources is small.
    told = rows.join(known, F.col("source").eqNullSafe(F.col("of")))
    u = F.col("h") / _SPAN
    flying = told.where("share > 0").select("row", "source", "size", "h", "whole", F.col("share").alias("pi"), F.when((F.col("slices") == 0) | (u < F.col("reserved")), -1).otherwise(F.floor(u * F.col("slices"))).cast("int").alias("slice"))
    decided = []
    last = flying.where("slice = -1").drop("slice")
    most = known.agg(F.max("slices")).first()[0] or 0
    sliced, stage = flying.where("slice >= 0"), 0
    while most:
        flown = written(sliced.groupBy("source", "slice").applyInPandas(_flown(seed, stage), _FLOWN), "mix-flown")
        decided.append(flown.where("pi in (0, 1)"))
        undecided = flown.where("pi not in (0, 1)")
        most = most * 2 // group_rows  # slices that two documents of each slice fill again
        if not most:
            last = last.unionByName(undecided)
            break
        sliced, stage = undecided.withColumn("slice", F.floor(u * (most + 1)).cast("int")), stage + 1
        most += 1
    decided.append(last.groupBy("source").applyInPandas(_flown(seed, -1, cap), _FLOWN))
    more = reduce(DataFrame.unionByName, decided).where("pi != 0").select(F.col("row").alias("r"), F.col("pi").cast("int").alias("more"))
    copies = F.col("whole") + F.coalesce("more", F.lit(0))
    out = told.join(more.hint("merge"), F.col("row") == F.col("r"), "left")
    return out.select(F.col("id").alias(id_col), "text_key", F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
