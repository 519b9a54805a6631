"""What the operators of this package share: the shared folder, written tables, hashes and a bounded filter."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the control characters 9 to 13.
WHITESPACE = " \t\n\x0b\x0c\r"

#: Slots of ``slot_filter`` where no count is known: 2**24 bits are 2 MB, whatever the input holds.
FILTER_BITS = 24
_BUCKET = 32768  # bits that bitmap_construct_agg keeps in one row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set here only in local mode, where one machine holds everything; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", f"millrace-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """While a table is written, Spark deletes the shuffle files of that one execution at its end: the table replaces them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Paths of the tables that ``written`` made, in order, until they are deleted.
TABLES: list[str] = []


def written(df: DataFrame, tag: str, **options: object) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with _shuffles_go(spark):
        df.write.options(**options).parquet(path)
    TABLES.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        discard_paths(t.sparkSession, [t.written_to])


def discard_paths(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        if path in TABLES:
            TABLES.remove(path)
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Deletes all that ``written`` left in the shared folder; results that still read it become invalid."""
    TABLES.clear()
    _delete(spark, f"{shared_dir(spark)}/millrace")


def worker_store(token: str | None) -> dict:
    """What this Python worker keeps from task to task for the holder of the token. What another holder left is dropped, so that a worker, which
    outlives its stage, keeps one at most and none after a task that asks for None."""
    store = sys.modules.setdefault("_millrace_kept", types.ModuleType("_millrace_kept")).__dict__
    if store.get("token", "") != token:
        store.clear()
        store["token"] = token
    return store


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty. Chained replacements stay on bytes, unlike a regex."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITESPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def seeded(key: Column, seed: int) -> Column:
    """A 52-bit hash of a key's text and a seed that other SQL engines can compute too; a null key hashes as ''."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def filter_bits(keys: int) -> int:
    """Bits, as a power of two, of a filter for so many keys: 16 a key, from 2 MB to 64 MB at most."""
    return min(29, max(FILTER_BITS, (16 * keys).bit_length()))


def slot_filter(keys: DataFrame, hash_column: str, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of the slots that keys' non-negative 64-bit hashes fall into: rows of 4 KB, 2**bits / 8 bytes at most, whatever keys holds."""
    slot = F.col(hash_column) % (1 << bits)
    return keys.groupBy(F.expr(f"cast(({hash_column} % {1 << bits}) div {_BUCKET} as bigint)").alias("__bucket")).agg(
        F.bitmap_construct_agg((slot % _BUCKET)).alias("__bits")
    )


def may_match(rows: DataFrame, hash_column: str, slots: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows whose hash may be among the filter's keys: no false negatives; beyond its capacity more false positives, never other results.

    The filter is broadcast: its size is fixed by bits, not by the data.
    """
    bit = f"(({hash_column} % {1 << bits}) % {_BUCKET})"
    byte = F.expr(f"cast(conv(hex(substring(__bits, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int)")
    in_slot = byte.bitwiseAND(F.expr(f"shiftleft(1, cast({bit} % 8 as int))")) != 0
    on = (F.expr(f"cast(({hash_column} % {1 << bits}) div {_BUCKET} as bigint)") == F.col("__bucket")) & in_slot
    return rows.join(F.broadcast(slots), on, "left_semi")
