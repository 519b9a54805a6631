"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into classes that double in size. For each class a document is cut into windows
of twice the class's largest item, each half over the next, so that an item meets sets of about its own size however long
the document is. The sketch of a set is a one-permutation MinHash: the least hash in each of a number of bins; for items of up to 63
shingles the bins are so many that the sketch is the set. A window's sketch is taken of those of its shingles that some item has, as the
others could only displace what can match; a bitmap of fixed size tells them. An item is a candidate where a minimum equals one
of the rarer half of its minima (for the small classes: of so many of the rarest that a contained item must share one). Candidates
are verified by the exact share of the item's shingles that the whole document contains.

Texts are read and hashed once. Documents without a shingle of any item end there, as they contain nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, filter_bits, slot_filter, table, written
from millrace.llm.shingles import WORDS, distinct, grams, lists, mix, shingle_hashes, slices, word_hashes

_EXACT = 5  # classes up to this one have sketches that are the sets


def bins_of(size_class: int) -> int:
    """Bins of a sketch of the class of items with 2**size_class or more shingles."""
    return 1 << 20 if size_class <= _EXACT else 256


def sketch(h: np.ndarray, group: np.ndarray, size_class: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, group) of the least hash in every bin of every group that has one there; the small classes keep all."""
    if size_class > _EXACT:
        cell = group * bins_of(size_class) + (h % np.uint64(bins_of(size_class))).astype(np.int64)
        order = np.lexsort((h, cell))
        cell = cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        h, group = h[order][first], cell[first] // bins_of(size_class)
    return mix(h + np.uint64(size_class + 1)), group


def windows(h: np.ndarray, place: np.ndarray, row: np.ndarray, size_class: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, window, row of each window): windows of 2**(size_class + 2) shingles at every 2**(size_class + 1); a shingle lies in two at most.

    place: where in its row a shingle stands; counts: shingles of each row.
    """
    step = 1 << (size_class + 1)
    per_row = np.maximum(1, -(-counts // step))
    base = np.cumsum(per_row) - per_row
    own = base[row] + place // step
    earlier = place >= step
    return np.concatenate([h, h[earlier]]), np.concatenate([own, own[earlier] - 1]), np.repeat(np.arange(len(counts)), per_row)


def item_sets(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, size, size_class, keys, shingles) per item that has a shingle; words: how many the shingles have."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(1)):
                part = batch.column(1).slice(start, n)
                words = np.minimum(np.bincount(word_hashes(part)[1], minlength=n), WORDS)
                h, row, _ = distinct(*shingle_hashes(part))
                size = np.bincount(row, minlength=n)
                size_class = np.log2(np.maximum(size, 1)).astype(np.int64)
                keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for c in np.unique(size_class[size > 0]).tolist():
                    of = size_class[row] == c
                    key, owner = sketch(h[of], row[of], c)
                    keys.append(key), owners.append(owner)
                key, owner = np.concatenate(keys), np.concatenate(owners)
                order = np.argsort(owner, kind="stable")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(words.astype(np.int64)), pa.array(size.astype(np.int64)), pa.array(size_class), lists(key[order], owner[order], n), lists(h, row, n)], names=["item", "words", "size", "size_class", "keys", "shingles"])

    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"item {kind}, words long, size long, size_class long, keys array<long>, shingles array<long>").where("size > 0")


def _bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the lowest ``bits`` bits of column h: 2**bits / 8 bytes, whatever values holds."""
    out = np.zeros((1 << bits) // 8, np.uint8)
    slots = values.withColumn("slot", F.col("h").bitwiseAND(F.lit((1 << bits) - 1)))
    for r in slot_filter(slots, "slot", bits).collect():
        out[r[0] * 4096 : (r[0] + 1) * 4096] = np.frombuffer(r[1], np.uint8)
    return out


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row (id, text_key, item, shared, item_shingles, containment) per document and item with at least ``threshold`` of the item's distinct shingles in the document.

    A shingle is five consecutive words; an item of fewer words is one shingle of all of them, and lies in documents that hold
    these words in a row. Null texts are empty; an empty document contains nothing and an empty item is in nothing. A document is its id and
    text: text_key is the MD5 of the text, rows that repeat both are one, and a (document, item) pair is returned once. Equal items are found
    each by its own id; of items that repeat an id, each is searched and the row with the largest share is returned. Other columns
    are not read; empty tables give an empty result.

    Items of up to 63 shingles are found without fail. A larger one that stands in one piece is missed only if in its window all of at least 28 minima are displaced
    by shingles of other items, each with a probability of 3/4 at most: 3e-4 where a document is made of other items alone, else far less.
    """
    found_items = written(item_sets(items, item_col, item_text_col).withColumn("n", F.monotonically_increasing_id()), "items")
    facts = found_items.select("size_class", "words").distinct().collect()  # 63 classes and 5 lengths at most
    classes, lengths = sorted({r[0] for r in facts}), sorted({r[1] for r in facts if r[1] < WORDS})
    shingles = found_items.select(F.explode("shingles").alias("h"))
    bits = filter_bits(shingles.count())
    bitmap = _bitmap(shingles, bits)
    # The rarest keys of an item are enough: a contained small item must share one of them.
    often = found_items.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("often"))
    ranked = found_items.select("n", "size", "size_class", F.explode("keys").alias("k")).join(often, "k").groupBy("n", "size", "size_class").agg(F.array_sort(F.collect_list(F.struct("often", "k"))).alias("keys"))
    enough = F.when(F.col("size_class") <= _EXACT, F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).otherwise(F.ceil(F.size("keys") / 2)).cast("int")
    keys = written(ranked.select("n", F.explode(F.slice("keys", F.lit(1), enough)).alias("key")).select("n", "key.k"), "item-keys")
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(2)):
                word, row = word_hashes(batch.column(2).slice(start, n))
                hits, keys, owners = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for length in [WORDS, *lengths]:
                    h, at = grams(word, row, length)
                    counts = np.bincount(at, minlength=n)
                    low = (h & np.uint64((1 << bits) - 1)).astype(np.int64)
                    hit = np.flatnonzero((bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1)
                    h, at, place = h[hit], at[hit], hit - (np.cumsum(counts) - counts)[at[hit]]
                    hits.append((h, at))
                    many = np.bincount(at, minlength=n)
                    for c in classes if length == WORDS else [0]:
                        can = many[at] >= threshold * (1 << c) - 1e-9
                        if can.any():
                            key, window = sketch(*(w := windows(h[can], place[can], at[can], c, counts))[:2], c)
                            keys.append(key), owners.append(w[2][window])
                key, owner, _ = distinct(np.concatenate(keys), np.concatenate(owners))
                h, at, _ = distinct(*(np.concatenate(x) for x in zip(*hits, strict=True)))
                some = np.bincount(owner, minlength=n) > 0
                of = some[at]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), batch.column(1).slice(start, n), lists(h[of], at[of], n), lists(key, owner, n)], names=["id", "text_key", "hits", "keys"])
                yield rows.filter(pa.array(some))

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hit = texts.select("id", F.unhex(F.md5("text")).alias("text_key"), "text").mapInArrow(run, f"id {id_kind}, text_key binary, hits array<long>, keys array<long>")
    hit = written(hit.withColumn("doc", F.monotonically_increasing_id()), "hits")
    pairs = hit.select("doc", F.explode("keys").alias("k")).join(keys, "k").select("doc", "n").distinct()
    sets = found_items.select("n", "item", "shingles", F.col("size").alias("item_shingles"))
    candidates = pairs.join(sets, "n").join(hit.select("doc", "id", "text_key", "hits"), "doc")
    counted = candidates.select("id", "text_key", "item", F.size(F.array_intersect("hits", "shingles")).cast("long").alias("shared"), "item_shingles")
    counted = counted.withColumn("containment", F.col("shared") / F.col("item_shingles")).where(F.col("containment") >= threshold)
    best = counted.groupBy("id", "text_key", "item").agg(F.max(F.struct("containment", "shared", "item_shingles")).alias("best"))
    return best.select(F.col("id").alias(id_col), "text_key", F.col("item").alias(item_col), "best.shared", "best.item_shingles", "best.containment")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "shared", "item_shingles")).alias("best"))
    return best.select("doc_id", "item_id", "best.shared", "best.item_shingles", "best.containment")


def _sql_words(source: str, id_col: str) -> str:
    return f"SELECT {id_col} AS id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {source}"


OP10_SQL = f"""
WITH dw AS ({_sql_words('documents', 'doc_id')}),
bw AS ({_sql_words('benchmark', 'item_id')}),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM bw WHERE len(w) > 0),
d AS (SELECT DISTINCT id, w[i:i + k - 1] AS s
      FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, k WHERE len(w) >= k)),
b AS (SELECT DISTINCT id, w[i:i + k - 1] AS s
      FROM (SELECT id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM bw WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS item_shingles FROM b GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM m JOIN n ON n.id = item_id WHERE shared / item_shingles >= 0.8
"""
