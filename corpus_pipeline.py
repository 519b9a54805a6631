"""A corpus pipeline of five stages, each of which calls one operator of ``millrace.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of ``documents``; extra columns of the input are dropped. Each stage works on every row that
it is given. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, mixing, near_dedup, sharding
from millrace.llm.common import TABLES, discard, discard_paths, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5
SHARDS = 24

#: Language identification is a trained model, so SQL can't express the whole.
ORACLE_SQL = None


#: Tables in the shared folder that the stage before left: its result reads them until it is written, which it is when the next stage begins.
_LEFT: list[str] = []


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stage before left in the shared folder."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_paths(spark, _LEFT)
        before = set(TABLES)
        out = f(spark, docs.select(*COLUMNS), sf_dir)
        _LEFT[:] = [path for path in TABLES if path not in before]
        return out

    return run_stage


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _of(keys: DataFrame) -> tuple[DataFrame, Column]:
    """The keys (doc_id, text_key) under other names, and the condition that a row has them. Spark broadcasts them if they are few."""
    return keys.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key")), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty and letterless texts, and those whose best language is less likely than not."""
    found = language.identify(docs, language.train(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the one text that stands for each class. Rows that repeat its id and text are one document, and one stays."""
    classes = written(near_dedup.near_duplicates(docs).select("doc_id", "text_key", "stays"), "classes")
    go, goes = _of(written(classes.where("not stays").select("doc_id", "text_key").distinct(), "dropped"))
    kept = docs.withColumn("text_key", _text_key()).join(go, goes, "left_anti")
    repeated = written(classes.where("stays").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "repeated")
    if not repeated.isEmpty():
        again, is_again = _of(repeated)
        kept = kept.join(again, is_again, "left_anti").unionByName(kept.join(again, is_again, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return kept.select(*COLUMNS)


@_stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Another text under the same id stays."""
    leaks, leaked = _of(written(decontaminate.contained_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct(), "leaks"))
    return docs.withColumn("text_key", _text_key()).join(leaks, leaked, "left_anti").select(*COLUMNS)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every document as often as the mixture takes it; those it doesn't take go. Rows alike in id, source and text are taken
    together: the first of them is repeated as often as all of them are taken."""
    taken = mixing.mix(docs).groupBy("doc_id", "text_key", "source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    taken = written(taken.withColumnRenamed("source", "of_source"), "taken")
    keyed = docs.withColumn("text_key", _text_key())
    if not taken.where("rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", "text_key", "source"])
    _, is_of = _of(taken)
    of = taken.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "of_source", "copies")
    # Every document meets its number of copies: a sort-merge join at any size.
    mixed = keyed.join(of.hint("merge"), is_of & F.col("source").eqNullSafe(F.col("of_source")))
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select(*COLUMNS)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row."""
    return sharding.interleaved_shards(docs, shards=SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, last = written(stage(spark, docs, sf_dir), f"stage-{name}"), before
        if last is not None:
            discard(last)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
