"""Collections with a key: grouped reduction, joins and cogroups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.dataset import Dataset, arrow_schema, as_batch, numbered
from millrace.operators.iterate import cut


def _blocks(side: Keyed, column: str, name: str, rows: int) -> DataFrame:
    """The rows that can meet, with the number of their block of so many rows in the order of key and column."""
    there = side.df.dropna(subset=[*side.keys, column])
    order = F.struct(*side.keys, column, *(c for c in side.value_columns if c != column))  # in full, so that a task that is run again numbers alike
    return numbered(there.withColumn("__order", order), "__order", name).drop("__order").withColumn(name, F.expr(f"{name} div {rows}"))


class Keyed:
    """A DataFrame of which some columns are the key; the others are the value."""

    def __init__(self, df: DataFrame, keys: list[str]) -> None:
        self.df, self.keys = df, keys

    @property
    def value_columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.keys]

    # --- values
    def values(self) -> Dataset:
        return Dataset(self.df.drop(*self.keys))

    def map_values(self, **columns: Column) -> Keyed:
        return Keyed(self.df.select(*self.keys, *(c.alias(n) for n, c in columns.items())), self.keys)

    def flat_map_values(self, array: Column, name: str) -> Keyed:
        return Keyed(self.df.select(*self.keys, F.explode(array).alias(name)), self.keys)

    # --- aggregation
    def reduce_by_key(self, **aggregates: Column) -> Keyed:
        """Built-in aggregates combine on the map side."""
        return Keyed(self.df.groupBy(*self.keys).agg(*(c.alias(n) for n, c in aggregates.items())), self.keys)

    def group_by_key(self, name: str = "values") -> Keyed:
        """The values of a key as a sorted array. It holds a whole group; reduce where a reduction will do."""
        values = self.value_columns
        value = F.col(values[0]) if len(values) == 1 else F.struct(*values)
        return Keyed(self.df.groupBy(*self.keys).agg(F.array_sort(F.collect_list(value)).alias(name)), self.keys)

    def combine_by_key_py(self, create: Callable, merge_value: Callable, merge_combiners: Callable, state: str, *values: str) -> Keyed:
        """A user's combiner: create(*values) begins a state, merge_value(state, *values) adds to it, merge_combiners joins two. A state is a tuple of the fields in ``state``.

        Each Arrow batch gives a state per key, and only states are shuffled. They arrive sorted by key, so that a task holds one state
        at a time; of a hot key there is one for each batch. Aggregates that Spark has are faster by ``reduce_by_key``.
        """
        keys, n = self.keys, len(self.keys)
        fields = ", ".join(f"`{k}` {self.df.schema[k].dataType.simpleString()}" for k in keys)
        schema = f"{fields}, {state}"
        arrow = arrow_schema(schema)

        def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                states: dict[tuple, tuple] = {}
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = row[:n]
                    states[key] = merge_value(states[key], *row[n:]) if key in states else create(*row[n:])
                yield as_batch([(*k, *s) for k, s in states.items()], arrow)

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, now = None, None
            for batch in batches:
                done = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[:n] == key:
                        now = merge_combiners(now, row[n:])
                        continue
                    if key is not None:
                        done.append((*key, *now))
                    key, now = row[:n], row[n:]
                yield as_batch(done, arrow)
            if key is not None:
                yield as_batch([(*key, *now)], arrow)

        states = self.df.select(*keys, *values).mapInArrow(combined, schema)
        return Keyed(states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema), keys)

    def count_distinct(self, column: str, name: str) -> Keyed:
        return Keyed(self.df.groupBy(*self.keys).agg(F.countDistinct(column).alias(name)), self.keys)

    # --- placement
    def partition_by_key(self, partitions: int) -> Dataset:
        """Rows of a key together in one of so many partitions; the key goes."""
        return Dataset(self.df.repartition(partitions, *self.keys).drop(*self.keys))

    def partition_by_range(self, partitions: int, ascending: bool = True) -> Keyed:
        order = [F.col(k).asc() if ascending else F.col(k).desc() for k in self.keys]
        return Keyed(self.df.repartitionByRange(partitions, *order), self.keys)

    # --- joins
    def join(self, other: Keyed, how: str = "inner", where: Column | None = None) -> Keyed:
        """Equal keys meet; ``where`` is a further condition on the pair."""
        joined = self.df.join(other.df, self.keys, how)
        return Keyed(joined.where(where) if where is not None else joined, self.keys)

    def join_above(self, other: Keyed, over: str, under: str, left_rows: int = 1 << 15, right_rows: int = 1 << 12) -> Keyed:
        """Equal keys meet where column ``over`` of this side is above column ``under`` of the other.

        Both sides are numbered in the order of key and column and cut into blocks. Blocks of a key of which some pair can meet make a cell, a
        task's work: at most left_rows x right_rows pairs, however hot a key is. Pairs of blocks of which none can meet are never formed.
        """
        keys = self.keys
        left = _blocks(self, over, "__left", left_rows)
        right = _blocks(other, under, "__right", right_rows)
        highs = left.groupBy(*keys, "__left").agg(F.max(over).alias("__high"))
        lows = right.groupBy(*keys, "__right").agg(F.min(under).alias("__low"))
        cells = cut(highs.join(lows, keys).where("__high > __low").select(*keys, "__left", "__right"))
        tasks = max(1, min(cells.count(), 20_000))
        cell = [*keys, "__left", "__right"]
        a = left.join(cells, [*keys, "__left"]).repartition(tasks, *cell)
        b = right.join(cells, [*keys, "__right"]).repartition(tasks, *cell)
        met = a.join(b.hint("shuffle_hash"), cell).where(F.col(over) > F.col(under))
        return Keyed(met.drop("__left", "__right"), keys)

    def semi(self, other: Keyed) -> Keyed:
        return self.join(other, "left_semi")

    def anti(self, other: Keyed) -> Keyed:
        return self.join(other, "left_anti")

    def cogroup(self, other: Keyed, left: str = "left", right: str = "right", how: str = "inner") -> Keyed:
        """The values of both sides as sorted arrays, for keys of both; ``how='full'`` has keys of either, with empty arrays."""
        out = self.group_by_key(left).df.join(other.group_by_key(right).df, self.keys, how)
        if how != "inner":
            out = out.withColumns({c: F.coalesce(c, F.array()) for c in (left, right)})
        return Keyed(out, self.keys)

    def cogroup_py(self, other: Keyed, function: Callable, schema: str) -> Dataset:
        return Dataset(self.df.groupBy(*self.keys).cogroup(other.df.groupBy(*other.keys)).applyInPandas(function, schema))

    def sort_by_key(self, ascending: bool = True) -> Dataset:
        return Dataset(self.df.orderBy(*(F.col(k).asc() if ascending else F.col(k).desc() for k in self.keys)))
