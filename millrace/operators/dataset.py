"""A lazily evaluated collection of rows with the transformations and actions of a keyed-collection engine.

Functions are Column expressions; Catalyst sees through all of them. The methods that end in ``_py`` take Python functions over
Arrow batches and are for what expressions can't say. Transformations return a new Dataset, and actions that give one value return a
one-row DataFrame, so that nothing is computed before the caller collects.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce as _reduce
from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.operators.iterate import cut

if TYPE_CHECKING:
    from millrace.operators.keyed import Keyed


class Dataset:
    def __init__(self, df: DataFrame) -> None:
        self.df = df

    # --- sources
    @classmethod
    def of(cls, spark: SparkSession, rows: Iterable, schema: str, partitions: int | None = None) -> Dataset:
        df = spark.createDataFrame(list(rows), schema)
        return cls(df.repartition(partitions) if partitions else df)

    @classmethod
    def range(cls, spark: SparkSession, start: int, stop: int, partitions: int | None = None) -> Dataset:
        return cls(spark.range(start, stop, 1, partitions))

    # --- narrow transformations
    def map(self, **columns: Column) -> Dataset:
        return Dataset(self.df.select(*(c.alias(n) for n, c in columns.items())))

    def filter(self, condition: Column | str) -> Dataset:
        return Dataset(self.df.where(condition))

    def flat_map(self, array: Column, name: str, *keep: str) -> Dataset:
        """A row for each element of the array expression, with the columns to keep."""
        return Dataset(self.df.select(*keep, F.explode(array).alias(name)))

    def map_partitions_py(self, function: Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]], schema: str) -> Dataset:
        """Batches of a partition in, batches out."""
        return Dataset(self.df.mapInPandas(function, schema))

    def with_partition(self, name: str = "partition") -> Dataset:
        return Dataset(self.df.withColumn(name, F.spark_partition_id()))

    def key_by(self, key: Column, name: str = "key") -> Keyed:
        from millrace.operators.keyed import Keyed

        return Keyed(self.df.withColumn(name, key), [name])

    def zip(self, other: Dataset, order: str, other_order: str) -> Dataset:
        """Pairs the rows by position in the given orders and ends with the shorter. The orders must be keys, or positions are arbitrary.

        Places are counted per range of the order and summed, so no task holds the whole.
        """
        a, b = numbered(self.df, order, "__place"), numbered(other.df, other_order, "__place")
        return Dataset(a.join(b, "__place").drop("__place"))

    def union(self, *others: Dataset) -> Dataset:
        """Keeps duplicates."""
        return Dataset(_reduce(DataFrame.unionByName, (o.df for o in others), self.df))

    def sample(self, fraction: float, with_replacement: bool = False, seed: int = 0, key: Column | None = None) -> Dataset:
        """Each row with the probability fraction, or as often as a Poisson number of that mean. With a key (a string that tells the rows apart) the
        draws are hashes of it, which neither partitions nor lost executors change; without, they are Spark's samplers."""
        if key is None:
            return Dataset(self.df.sample(with_replacement, fraction, seed))
        u = hashed(key, seed)
        if not with_replacement:
            return Dataset(self.df.where(u < fraction))
        times = sum(F.when(u >= below, 1).otherwise(0) for below in poisson_steps(fraction))
        return Dataset(self.df.withColumn("__times", times).where("__times > 0").withColumn("__times", F.explode(F.sequence(F.lit(1), "__times"))).drop("__times"))

    def cache(self) -> Dataset:
        return Dataset(self.df.persist(StorageLevel.MEMORY_AND_DISK))

    def uncache(self) -> Dataset:
        return Dataset(self.df.unpersist(blocking=True))

    # --- wide transformations
    def distinct(self, *columns: str) -> Dataset:
        return Dataset((self.df.select(*columns) if columns else self.df).distinct())

    def sort_by(self, *keys: Column | str) -> Dataset:
        """Globally, by any mixture of ascending and descending keys."""
        return Dataset(self.df.orderBy(*keys))

    def take(self, n: int, *keys: Column | str) -> Dataset:
        """The first n rows in the order of the keys; without keys, any n."""
        return Dataset((self.df.orderBy(*keys) if keys else self.df).limit(n))

    def top(self, n: int, key: Column, *ties: Column | str) -> Dataset:
        return Dataset(self.df.orderBy(key.desc(), *ties).limit(n))

    # --- actions
    def collect(self) -> list:
        return self.df.collect()

    def count(self) -> DataFrame:
        return self.df.agg(F.count(F.lit(1)).alias("count"))

    def reduce(self, **aggregates: Column) -> DataFrame:
        """Associative aggregates over all rows; null where there is none."""
        return self.df.agg(*(c.alias(n) for n, c in aggregates.items()))

    def fold(self, zero: object, **aggregates: Column) -> DataFrame:
        """As reduce, with a neutral zero for no rows. A zero that is not neutral would be counted as often as there are partitions, so it is used for no rows alone."""
        return self.df.agg(*(F.coalesce(c, F.lit(zero)).alias(n) for n, c in aggregates.items()))

    def aggregate_py(self, zero: Callable[[], object], step: Callable, merge: Callable, state: str, *columns: str) -> DataFrame:
        """A user's aggregate, one row. step(state, *values) folds the rows of a partition, merge the states of the partitions; a state is a tuple of the fields in ``state``.

        zero must be neutral to both. Nothing moves but a state for each partition.
        """

        arrow = arrow_schema(state)

        def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = zero()
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    now = step(now, *row)
            yield as_batch([now], arrow)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = zero()
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    now = merge(now, row)
            yield as_batch([now], arrow)

        return self.df.select(*columns).mapInArrow(folded, state).repartition(1).mapInArrow(merged, state)

    def take_sample(self, n: int, key: Column | str, seed: int = 0) -> Dataset:
        """Exactly n rows, or all if there are fewer, without replacement: those whose seeded hash of the key is smallest."""
        key = F.col(key) if isinstance(key, str) else key
        return Dataset(self.df.orderBy(hashed(key, seed), key).limit(n))

    def take_sample_with_replacement(self, n: int, order: str, seed: int = 0) -> Dataset:
        """Exactly n draws of rows, by their places in the order, which must be a key; none from an empty collection."""
        total = self.df.count()
        if not total:
            return Dataset(self.df.limit(0))
        draws = self.df.sparkSession.range(n).select(F.floor(hashed(F.col("id"), seed) * total).cast("bigint").alias("__place"))
        return Dataset(numbered(self.df, order, "__place").join(draws, "__place").drop("__place"))

    def shuffle(self, seed: int = 0, key: Column | None = None) -> Dataset:
        """All rows in random order; with a key, in that of its hashes, which is the same each time."""
        return Dataset(self.df.orderBy(F.rand(seed)) if key is None else self.df.orderBy(hashed(key, seed), key))

    def split(self, *weights: float, seed: int = 0, key: Column | None = None) -> list[Dataset]:
        """Parts that share the rows in proportion to the weights; with a key, by its hashes."""
        if key is None:
            return [Dataset(d) for d in self.df.randomSplit(list(weights), seed)]
        ends = [sum(weights[:i]) / sum(weights) for i in range(len(weights))] + [1.0]
        return [self.cell(a, b, seed, key=key) for a, b in zip(ends, ends[1:], strict=False)]

    def cell(self, lower: float, upper: float, seed: int = 0, complement: bool = False, key: Column | None = None) -> Dataset:
        """The rows whose random number (with a key: its hash) lies in [lower, upper), or the others."""
        inside = (F.col("__u") >= lower) & (F.col("__u") < upper)
        return Dataset(self.df.withColumn("__u", F.rand(seed) if key is None else hashed(key, seed)).where(~inside if complement else inside).drop("__u"))


def hashed(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the key's text and the seed; null counts as ''."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def poisson_steps(mean: float) -> list[float]:
    """The probabilities of at most 0, 1, 2, ... events, as far as doubles tell them from 1."""
    out, term, k = [], math.exp(-mean), 0
    total = term
    while total < 1 and term > 1e-17:
        out.append(total)
        k += 1
        term *= mean / k
        total += term
    return out


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow form of a schema written as in SQL; only the driver can tell."""
    return to_arrow_schema(StructType.fromDDL(schema))


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Tuples as an Arrow batch."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def fraction_for(n: int, total: int, with_replacement: bool = False) -> float:
    """A sampling fraction that gives at least n of total rows with probability 0.9999: by Chernoff's bound without replacement, by nine or five standard deviations with."""
    f = n / total
    if with_replacement:
        return f + (9.0 if n < 12 else 5.0) * (f / total) ** 0.5
    gamma = 9.2103 / total  # -log 0.0001
    return min(1.0, max(1e-10, f + gamma + (gamma * gamma + 2 * gamma * f) ** 0.5))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with the place of each row from 0 in the order. Range partitions are counted, and each numbers its own rows from the sum of those before it."""
    # A checkpoint, since ranges made anew after a lost executor could differ from those counted.
    ranged = cut(df.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.withColumn("__own", own).join(counts, "__part").withColumn(name, F.col("__before") + F.col("__own") - 1).drop("__part", "__own", "__n", "__before")
