"""Exact deduplication by a log-structured merge index, with DataFrame operations alone.

Flush: tasks are memtables. They combine the entries (digest, best identifier, count) of equal digests before anything moves, so that a digest
that holds a third of all rows leaves a task as one entry. The memtables of one batch of input partitions flush one run: sorted by
digest, an entry for each, with a filter, a bitmap of the slots that its digests fall into.
Compaction: an entry that no other run's filter may hold moves to the next level as it is. Only entries that hit a filter are merged, and
the best-ranked identifier stays. A later batch is merged into an index in the same way, by probing.
Hits: the bytes of all rows whose digest occurs more than once are compared: the least and the greatest text of a digest must be equal.
Digests whose texts differ are grouped anew by the bytes themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import filter_bits, may_match, slot_filter, squeezed, table, written

_BUCKET = 32768  # slots in a row of a filter


def _slot() -> Column:
    return F.xxhash64("digest").bitwiseAND(F.lit((1 << 62) - 1))


def _best() -> Column:
    """Most code points, then smallest id, null last."""
    return F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id")))


@dataclass
class Run:
    """A sorted run: (digest, id, points, n), one entry per digest."""

    entries: DataFrame
    size: int

    def filter(self, bits: int) -> DataFrame:
        """(bucket, bits): the slots of the run's digests, 2**bits at most."""
        return slot_filter(self.entries.withColumn("slot", _slot()), "slot", bits)


@dataclass
class Index:
    """A compacted run, and the documents (id, text) that it stands for, whose bytes later hits are held against."""

    run: Run
    docs: DataFrame


def entries_of(docs: DataFrame, id_col: str, text_col: str, digest_bits: int, batches: int) -> DataFrame:
    """(id, points, sha, digest, batch) per row, written: the log."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("points"), F.unhex(F.sha2(squeezed(F.col(text_col)), 256)).alias("sha"))
    batch = F.pmod(F.spark_partition_id(), F.lit(batches))
    return written(rows.withColumn("digest", F.substring("sha", 1, digest_bits // 8)).withColumn("batch", batch), "log")


def flush(log: DataFrame, batches: int) -> list[Run]:
    """Level 0: a run for each batch of memtables."""
    found = log.groupBy("batch", "digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
    found = found.select("batch", "digest", "best.id", (-F.col("best.p")).alias("points"), "n")
    runs = written(found.sortWithinPartitions("batch", "digest"), "runs")
    sizes = {r["batch"]: r["count"] for r in runs.groupBy("batch").count().collect()}  # a row for each batch
    return [Run(runs.where(F.col("batch") == b).drop("batch"), n) for b, n in sorted(sizes.items())]


def compact(runs: list[Run]) -> Run:
    """The next level: one run of all. Entries that hit no other run's filter pass, the others are merged by digest.

    The filters are broadcast; together they have 64 MB at most.
    """
    if len(runs) == 1:
        return runs[0]
    bits = min(filter_bits(max(r.size for r in runs)), 29 - (len(runs) - 1).bit_length())
    every = reduce(DataFrame.unionByName, (r.filter(bits).select(F.col("__bucket").alias("bucket"), F.lit(k).alias("run"), F.col("__bits").alias("bits")) for k, r in enumerate(runs)))
    filters = written(every.groupBy("bucket").agg(*(F.max(F.when(F.col("run") == k, F.col("bits"))).alias(str(k)) for k in range(len(runs)))), "filters")
    slot = f"(slot % {1 << bits})"
    byte = lambda k: f"cast(conv(hex(substring(`{k}`, cast({slot} % {_BUCKET} div 8 as int) + 1, 1)), 16, 10) as int)"
    probe = lambda k: F.expr(f"coalesce({byte(k)} & shiftleft(1, cast({slot} % 8 as int)), 0) != 0")

    def probed(k: int, r: Run) -> DataFrame:
        rows = r.entries.withColumn("slot", _slot()).withColumn("bucket", F.expr(f"cast({slot} div {_BUCKET} as bigint)"))
        hit = reduce(Column.__or__, (probe(j) for j in range(len(runs)) if j != k))
        return rows.join(F.broadcast(filters), "bucket").select("digest", "id", "points", "n", hit.alias("hit"))

    entries = written(reduce(DataFrame.unionByName, (probed(k, r) for k, r in enumerate(runs))), "probed")
    merged = entries.where("hit").groupBy("digest").agg(_best().alias("best"), F.sum("n").alias("n")).select("digest", "best.id", (-F.col("best.p")).alias("points"), "n")
    level = written(entries.where("not hit").drop("hit").unionByName(merged).sortWithinPartitions("digest"), "level")
    return Run(level, sum(r.size for r in runs))


def insert(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, batches: int = 4) -> tuple[Index, DataFrame]:
    """The index with the documents in it, and their log."""
    log = entries_of(docs, id_col, text_col, digest_bits, batches)
    runs = flush(log, batches) or [Run(log.select("digest", "id", "points", F.lit(1).cast("long").alias("n")), 0)]
    level0 = compact(runs)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if index is None:
        return Index(level0, own), log
    return Index(compact([index.run, level0]), index.docs.unionByName(own)), log


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256, index: Index | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space (space, 9 to 13) goes; null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest id (a null id only if there is no other). Rows that repeat an id
    with an equally long equal text are one document twice: each carries kept = true. Other columns are not read.
    An empty table gives an empty result. ``digest_bits`` (a multiple of 8) shortens the index key; texts that then
    share a key are told apart by their bytes. With an index (of the same digest_bits) the rows are held against its documents too.
    """
    whole, log = insert(docs, index, id_col, text_col, digest_bits)
    hits = written(whole.run.entries.where("n > 1").select(F.col("digest").alias("of"), F.col("id").alias("keep_id"), F.col("points").alias("keep_points"), F.col("n").alias("group_size")), "hits")
    bits = filter_bits(hits.count())
    slots = slot_filter(hits.select(F.col("of").alias("digest")).withColumn("slot", _slot()), "slot", bits)
    norm, text = squeezed(F.col("text")), F.coalesce(F.col("text"), F.lit(""))
    texts = whole.docs.select("id", F.char_length(text).cast("long").alias("points"), norm.alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    texts = texts.withColumn("digest", F.substring("sha", 1, digest_bits // 8)).withColumn("slot", _slot())
    # Nearly only hits pass; a task sends two texts of a digest at most.
    candidates = may_match(texts, "slot", slots, bits).drop("slot")
    differ = candidates.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).where("low != high").select("digest")
    differ = written(differ, "differ")
    found = F.col("group_size").isNotNull()
    kept = ~found | (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))
    told = log.join(hits, F.col("digest") == F.col("of"), "left").select("id", "points", "sha", "digest", F.when(found, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"))
    if not differ.isEmpty():
        # Digests shared by different bytes: the bytes are the key. Every row of such a digest passed the filter above.
        by_bytes = candidates.join(differ, "digest", "left_semi").groupBy("norm").agg(_best().alias("best"), F.count(F.lit(1)).alias("group_size"))
        by_bytes = by_bytes.select("norm", F.col("best.id").alias("keep_id"), (-F.col("best.p")).alias("keep_points"), "group_size")
        again = docs.select(F.col(id_col).alias("id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"), squeezed(F.col(text_col)).alias("norm")).withColumn("sha", F.unhex(F.sha2("norm", 256)))
        again = again.withColumn("digest", F.substring("sha", 1, digest_bits // 8)).join(differ, "digest", "left_semi").join(by_bytes, "norm")
        told = told.join(differ, "digest", "left_anti").unionByName(again.select("id", "points", "sha", "digest", "keep_id", "group_size", kept.alias("kept")))
    return told.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
