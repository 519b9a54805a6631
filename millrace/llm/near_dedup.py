"""Near-duplicate classes by ProbMinHash, banding and exact verification.

A text is its set of five-word shingles; equal sets are one node before anything else, so copies never meet in a bucket.
A node has a signature of its shingles with equal weights, since links are defined on sets, and, if some occur more often than others,
a shorter one with the weights 1 + log of how often they occur. Each shingle is a Poisson process whose rate is its weight
and whose arrivals fall on random components of the signature; a component keeps the shingle that arrives first, so two
signatures agree in a component with the probability Jaccard similarity. Shingles stop arriving once they are
later than the latest component (early termination).

1. Bands of the signatures are buckets. Those of equal weights alone have the recall that is claimed; the others add candidates. Buckets
   with the same members are one.
2. A bucket's members are paired with its least node, never with each other. A pair is judged by sizes, then by one bit of each
   component, and only what passes both by the exact Jaccard similarity of the shingle sets.
3. Links are contracted to connected components by alternating large and small stars. Buckets that still hold members of several
   components, which were not compared, get further random pivots. A pivot has met all others and leaves its bucket.
4. What is left after those rounds goes through an exact prefix filter: the shingles of a node in order of rarity, of which similar
   sets share one among the first few. Nodes that could only be alike by shingles that many share are represented by one node for every
   set of those, so that a common passage does not pair all documents that hold it.

Everything is a DataFrame in the shared folder; the driver only sees counts. Joins that grow with the data are sort-merge joins, which adaptive
execution splits where a key is hot.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import discard, filter_bits, may_match, slot_filter, table, worker_store, written
from millrace.llm.shingles import distinct, lists, mix, shingle_hashes, slices

_GOLDEN = 0x9E3779B97F4A7C15
_MISSED = 14.0  # a true link fails the one-bit test with a probability of at most exp(-14)

def probminhash(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, components: int) -> np.ndarray:
    """The element that arrives first in each component, row by component. Rows must have an element each; (h, row) must not repeat."""
    first = np.full(rows * components, np.inf)
    found = np.zeros(rows * components, np.uint64)
    alone = np.bincount(row, minlength=rows) == 1
    single = alone[row]
    found.reshape(rows, components)[row[single]] = h[single, None]
    h, row, weight = h[~single], row[~single], weight[~single]
    at, step = np.zeros(len(h)), 0
    while len(h):
        # Several arrivals at once when few elements are left; a sum goes on one by one, so that times don't depend on that.
        k = max(1, min(64, (1 << 16) // len(h)))
        u = mix(h[:, None] + np.arange(step + 1, step + k + 1, dtype=np.uint64) * np.uint64(_GOLDEN))
        gap = -np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        times = np.cumsum(np.column_stack([at, gap]), axis=1)[:, 1:]
        cell = row[:, None] * components + (mix(u) % np.uint64(components)).astype(np.int64)
        early = times < first[cell]
        who, cell, when = np.broadcast_to(h[:, None], early.shape)[early], cell[early], times[early]
        np.minimum.at(first, cell, when)
        won = first[cell] == when
        found[cell[won]] = who[won]
        at, step = times[:, -1], step + k
        open_ = np.flatnonzero(np.bincount(row, minlength=rows))
        latest = np.zeros(rows)
        latest[open_] = first.reshape(rows, components)[open_].max(axis=1)
        goes_on = at < latest[row]
        h, row, weight, at = h[goes_on], row[goes_on], weight[goes_on], at[goes_on]
    return found.reshape(rows, components)


def _signed(texts: DataFrame, bands: int, width: int, extra: int) -> DataFrame:
    """(id, key, low, high, size, bits, bands) per row of (id, key, text): a 128-bit digest (low, high) of the set of shingles, its size, a bit per
    component and one hash per band, ``bands`` with equal weights and, where shingles occur unequally often, ``extra`` by count. Texts without
    words have size 0 and no bands."""
    kind = texts.schema["id"].dataType.simpleString()

    def signature(h: np.ndarray, row: np.ndarray, weight: np.ndarray, n: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = np.flatnonzero(np.bincount(row, minlength=n))
        found = probminhash(h, np.searchsorted(full, row), weight, len(full), many * width)
        parts = found.reshape(-1, many, width)
        key = sum(mix(parts[:, :, k] + np.uint64((k + 1) * _GOLDEN % (1 << 64))) for k in range(width))
        return found, mix(key + np.arange(many, dtype=np.uint64)[None, :]).ravel(), np.repeat(full, many)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_store(None)
        for batch in batches:
            for start, n in slices(batch.column(2)):
                part = batch.slice(start, n)
                h, row, count = distinct(*shingle_hashes(part.column(2)))
                size = np.bincount(row, minlength=n)
                first = np.flatnonzero(size[row] > 0) if not len(row) else np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                digest = np.zeros((2, n), np.uint64)
                for k in range(2):
                    if len(h):
                        digest[k, row[first]] = np.add.reduceat(mix(h + np.uint64(k + 1)), first)
                top, low = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
                np.maximum.at(top, row, count)
                np.minimum.at(low, row, count)
                uneven = (top > low)[row]
                found, key, at = signature(h, row, np.ones(len(h)), n, bands)
                bits = np.packbits((mix(found) >> np.uint64(63)).astype(np.uint8), axis=1)
                bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)
                _, more, where = signature(h[uneven], row[uneven], 1 + np.log(count[uneven]), n, extra)
                key, at, _ = distinct(np.concatenate([key, more]), np.concatenate([at, where]))
                bit_rows = np.repeat(np.flatnonzero(size), bits.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(d.view(np.int64)) for d in digest), pa.array(size.astype(np.int64)), lists(bits.ravel(), bit_rows, n), lists(key, at, n)],
                    names=["id", "key", "low", "high", "size", "bits", "bands"],
                )

    return texts.select("id", "key", "text").mapInArrow(run, f"id {kind}, key binary, low long, high long, size long, bits array<long>, bands array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) per row of (node, text): the distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(1)):
                h, row, _ = distinct(*shingle_hashes(batch.column(1).slice(start, n)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), lists(h, row, n)], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all links (a, b) at once: labels fall to the least of their links and then to their label's label, until nothing changes."""
    parts = [np.asarray(b.column(k), np.int64) for b in batches for k in (0, 1)]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate([*parts[::2], *parts[1::2]]), return_inverse=True)
    a, b = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, label[end], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "component"])


def connected(links: DataFrame, one_task: int = 1_000_000) -> DataFrame:
    """(node, component) of every node in links (a, b) of longs, the component being its least node.

    Up to ``one_task`` links, 16 bytes each, are united in one task, as there a round of joins takes longer than the whole; more by alternating large and small
    stars until nothing changes. The result is the same.
    """
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_united, "node long, component long")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-stars")
        discard(edges)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "edges")
        discard(large)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def bits_apart(threshold: float, components: int) -> int:
    """The most bits in which two signatures may differ for the pair to be looked at further.

    A bit agrees with probability (1 + similarity) / 2. By Chernoff's bound a pair at the threshold differs in more bits with a
    probability of at most exp(-_MISSED).
    """
    q = (1 - threshold) / 2
    for apart in range(math.ceil(q * components), components):
        x = (apart + 1) / components
        if x > q and components * (x * math.log(x / q) + ((1 - x) * math.log((1 - x) / (1 - q)) if x < 1 else 0.0)) >= _MISSED:
            return apart
    return components


def _plausible(pairs: DataFrame, sketches: DataFrame, threshold: float, apart: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the threshold and whose one-bit signatures are near enough."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("bits").alias(f"s{x}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return both.where((F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9) & (differ <= apart)).select("a", "b")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")).hint("merge"), "a")
    both = a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).hint("merge"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("similarity")).where(F.col("similarity") >= threshold).select("a", "b")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 48, width: int = 6, rounds: int = 2, extra: int = 8, hot: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, text_key, class_id, class_size, stays.

    Documents are linked if the Jaccard similarity of their sets of five-word shingles is at least ``threshold``;
    classes are the connected components, named by their least id (null last). A text of one to four words
    is one shingle. Null counts as empty; all texts without words are classes of their own each, unless they repeat an id.
    text_key is the MD5 of the text. stays tells the one text of the class that stands for it: that of the least id and, of texts
    that repeat this id, the one of least key; rows that repeat both are one document and all bear it. If an id repeats with different texts, each row is in
    the class of its text, and both classes may bear the name. Other columns are not read; an empty table gives an empty result.

    With 48 bands of 6, a pair of similarity 0.8 shares no bucket with probability 5e-7, however often shingles repeat, and is
    lost by the one-bit test with probability 1e-6 at most. Both fall quickly above 0.8.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    signed = written(_signed(rows, bands, width, extra), "signatures")
    first = lambda *more: F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("key").alias("key"), *more))
    nodes = signed.where("size > 0").groupBy("low", "high").agg(first().alias("one"), F.any_value(F.struct("size", "bits", "bands")).alias("of"))
    # Numbers are given where the table is written, once; all later reads are of the written table.
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "low", "high", "one.id", "one.key", "of.*"), "nodes")
    thin = written(signed.select("id", "key", "low", "high", "size"), "rows")
    discard(signed)

    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("pivot")).where("n > 1")
    buckets = buckets.groupBy("n", "who", "pivot").agg(F.min("bucket").alias("bucket")).select("bucket", "n", "pivot")
    members = written(members.join(buckets.hint("merge"), "bucket").where("node != pivot"), "buckets")
    sketches, apart = nodes.select("node", "size", "bits"), bits_apart(threshold, bands * width)
    pairs = members.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
    pairs = written(_plausible(pairs, sketches, threshold, apart), "pairs")
    still = written(members.where("n > 2").select("bucket", "node"), "members")
    discard(members)

    # The shingles of the nodes that may have to be compared, from the one row that stands for each.
    some = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(still.select(F.col("node").alias("a"))).distinct()
    slot = lambda of: F.xxhash64(of).bitwiseAND(F.lit((1 << 62) - 1))
    wanted = written(nodes.select("node", F.col("id").alias("i"), F.col("key").alias("k")).join(some.hint("merge"), F.col("node") == F.col("a")).select("node", "i", "k", slot("k").alias("slot")), "wanted")
    count = wanted.count()
    many = filter_bits(count)
    found = may_match(rows.withColumn("slot", slot("key")), "slot", slot_filter(wanted, "slot", many), many).select("id", "key", "text")
    sets = written(_sets(found.join(wanted.hint("merge"), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("i")))), "sets")
    if sets.count() > count:  # a row that repeats another's id and text
        sets = written(sets.dropDuplicates(["node"]), "sets")
    discard(wanted)

    links = written(_linked(pairs, sets, threshold), "links")
    discard(pairs)
    component = written(connected(links), "components")
    for turn in range(rounds):
        still = written(_mixed(_named(still, component)), "members")
        if still.isEmpty():
            break
        # Two random pivots for each bucket that still holds several components.
        order = [F.struct(F.xxhash64("node", "bucket", F.lit(2 * turn + k)), "node") for k in range(2)]
        pivots = still.groupBy("bucket").agg(F.array_distinct(F.array(*(F.min_by(F.struct("node", "component"), o) for o in order))).alias("pivots"))
        met = written(still.join(pivots.hint("merge"), "bucket"), "pivots")
        found = written(_linked(_plausible(_across(met).distinct(), sketches, threshold, apart), sets, threshold), "links")
        still = met.where(~F.exists("pivots", lambda p: p["node"] == F.col("node"))).select("bucket", "node")
        if not found.isEmpty():
            links = links.unionByName(found)
            component = written(connected(links), "components")

    # Exact rest: nodes that share a bucket across components and were not compared.
    rest = written(_mixed(_named(still, component)).select("node", "component").distinct(), "rest")
    found = None if rest.isEmpty() else _prefix_links(rest, sets, sketches, threshold, apart, hot)
    if found is not None:
        component = written(connected(links.unionByName(found)), "components")
    discard(sets)

    # A row's class: the component of its node, or the text itself if it has no words.
    named = nodes.select("low", "high", "node").join(component.hint("merge"), "node", "left").select(F.col("low").alias("l"), F.col("high").alias("h"), F.coalesce("component", "node").alias("component"))
    placed = thin.join(named.hint("merge"), (F.col("low") == F.col("l")) & (F.col("high") == F.col("h")) & (F.col("size") > 0), "left")
    own = F.when(F.col("size") == 0, F.struct(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.col("key")))
    placed = written(placed.select("id", "key", "component", own.alias("own")), "placed")
    classes = placed.groupBy("component", "own").agg(first().alias("one"), F.count(F.lit(1)).alias("class_size"))
    classes = classes.select(F.col("component").alias("c"), F.col("own").alias("o"), F.col("one.id").alias("class_id"), F.col("one.key").alias("of"), "class_size")
    out = placed.join(classes.hint("merge"), F.col("component").eqNullSafe(F.col("c")) & F.col("own").eqNullSafe(F.col("o")))
    stays = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("of"))
    return out.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), "class_id", "class_size", stays.alias("stays"))


def _named(members: DataFrame, component: DataFrame) -> DataFrame:
    """(bucket, node, component): a node without links is a component of its own."""
    return members.select("bucket", "node").join(component.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))


def _mixed(members: DataFrame) -> DataFrame:
    """The members (bucket, node, component, ...) of buckets with several components."""
    several = members.groupBy("bucket").agg(F.min("component").alias("c_low"), F.max("component").alias("c_high")).where("c_low != c_high").select("bucket")
    return members.join(several.hint("merge"), "bucket", "left_semi")


def _across(met: DataFrame) -> DataFrame:
    """The pairs (a, b) of members (node, component, pivots, ...) and the pivots of other components, at most two for each member. The other
    pivots go before they become rows."""
    others = F.filter("pivots", lambda p: p["component"] != F.col("component"))
    return met.select("node", F.explode(others).alias("p")).select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b"))


def _in_buckets(members: DataFrame, judge: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame | None:
    """What judge finds among the pairs (a, b) of nodes of different components that meet in a bucket; None if nothing.

    members: bucket, node, component, size and after, how many shingles follow this one in the order. All nodes of a bucket but those
    of its largest component become pivots, some 16 and then eight times as many, and meet the members whose size and place leave room for the threshold.
    """
    members, out, turn = written(_mixed(members), "prefixes"), None, 0
    while not members.isEmpty():
        parts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).select("bucket", F.col("top.component").alias("largest"), (F.col("n") - F.col("top.n")).alias("others"))
        u = F.xxhash64("node", F.lit(turn)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
        now = members.join(largest.hint("merge"), "bucket").withColumn("is_pivot", (F.col("component") != F.col("largest")) & (u * F.col("others") < 16.0 * 8.0**turn))
        now = written(now.drop("largest", "others"), "turn")
        discard(members)
        pivots = now.where("is_pivot").select(F.col("bucket").alias("in"), F.col("node").alias("pivot"), F.col("component").alias("of"), F.col("size").alias("s"), F.col("after").alias("rest"))
        need = F.ceil((F.col("size") + F.col("s")) * (threshold / (1 + threshold)) - 1e-9)
        fits = (F.col("component") != F.col("of")) & (F.least("size", "s") >= threshold * F.greatest("size", "s") - 1e-9) & (1 + F.least("after", "rest") >= need)
        pairs = now.join(pivots.hint("merge"), (F.col("bucket") == F.col("in")) & fits).select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        found = written(judge(pairs), "links")
        if not found.isEmpty():
            out = found if out is None else out.unionByName(found)
        # A pivot has met all others of its bucket; buckets of one component are done.
        members = written(_mixed(now.where("not is_pivot").drop("is_pivot")), "prefixes")
        discard(now)
        turn += 1
    return out


def _prefix_links(rest: DataFrame, sets: DataFrame, sketches: DataFrame, threshold: float, apart: int, hot: int = 1000) -> DataFrame | None:
    """The links among nodes of different components that the prefix filter finds; None if there is none.

    Two sets of similarity t share one of the first n - ceil(t n) + 1 shingles of either in any common order; the order is by rarity, and
    a pair always passes in the bucket of its first common shingle. If that shingle is in at most ``hot`` nodes, its bucket is small. Else the two
    share hot shingles alone, of which both mostly consist, so that their overlap is that of their sets of hot shingles. Of the nodes
    with the same such set one of least size stands for all: if a of one set and b of another are linked, so are a and the
    other's representative, both representatives, and b and the first's.
    """
    own = sets.join(rest.hint("merge"), "node").select("node", "component", F.size("shingles").alias("size"), "shingles")
    flat = own.select("node", F.explode("shingles").alias("shingle"))
    often = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    # Shingles of a single node can't be shared, but they count within the prefix: rare comes first.
    shared = flat.join(often.hint("merge"), "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("shared"))
    sized = own.select("node", "component", "size").join(shared.hint("merge"), "node").withColumn("before", F.col("size") - F.size("shared"))
    left = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1 - F.col("before")).cast("int")
    sized = written(sized.where(left > 0).withColumn("prefix", F.slice("shared", F.lit(1), F.least(left, F.size("shared")))), "prefix-sets")
    keys = sized.select("node", "component", "size", "before", F.posexplode("prefix").alias("k", "key")).where(F.col("key.often") <= hot)
    keys = keys.select(F.col("key.shingle").alias("bucket"), "node", "component", "size", (F.col("size") - F.col("before") - F.col("k") - 1).alias("after"))
    links = _in_buckets(keys, lambda pairs: _linked(_plausible(pairs, sketches, threshold, apart), sets, threshold), threshold)

    hot_set = F.transform(F.filter("shared", lambda x: x["often"] > hot), lambda x: x["shingle"])
    heavy = written(sized.where(F.element_at("prefix", -1)["often"] > hot).select("node", "component", "size", hot_set.alias("hot")), "heavy")
    discard(sized)
    if heavy.isEmpty():
        return links
    groups = written(heavy.groupBy("hot").agg(F.min(F.struct("size", "node", "component")).alias("one")).select("one.node", "one.size", "one.component", "hot"), "hot-sets")
    alike = lambda shared, m, n: shared / (F.col(m) + F.col(n) - shared) >= threshold
    inside = heavy.join(groups.select(F.col("node").alias("g"), F.col("size").alias("n"), F.col("hot").alias("of")).hint("merge"), F.col("hot") == F.col("of"))
    inside = written(inside.where("node != g").select("node", "g", "size", alike(F.size("hot"), "size", "n").alias("linked")), "hot-members")
    out = inside.where("linked").select(F.greatest("node", "g").alias("a"), F.least("node", "g").alias("b"))

    most = F.size("hot") - F.ceil(F.col("size") * threshold - 1e-9).cast("int") + 1
    # Representatives of one component need not meet, unless members who aren't linked to theirs wait for what it is near; such a one is a component of its own here.
    waits = inside.where("not linked").select(F.col("g").alias("waits")).distinct()
    keys = groups.where(most > 0).join(waits, F.col("node") == F.col("waits"), "left").withColumn("component", F.when(F.col("waits").isNull(), F.col("component")).otherwise(-1 - F.col("node")))
    keys = keys.select("node", "component", "size", F.size("hot").alias("h"), F.posexplode(F.slice("hot", F.lit(1), most)).alias("k", "bucket"))
    keys = keys.select("bucket", "node", "component", "size", (F.col("h") - F.col("k") - 1).alias("after"))

    def judge(pairs: DataFrame) -> DataFrame:
        side = lambda x: groups.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("hot").alias(f"h{x}")).hint("merge")
        both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("ha", "hb")))
        return both.where(alike(F.col("shared"), "na", "nb")).select("a", "b", "na", "nb", "shared")

    across = _in_buckets(keys, judge, threshold)
    if across is not None:
        out = out.unionByName(across.select("a", "b"))
        # Members that are too large for their own representative may still be near one with fewer shingles.
        partners = across.select(F.col("a").alias("g"), F.col("b").alias("p"), F.col("nb").alias("n"), "shared").unionByName(across.select(F.col("b").alias("g"), F.col("a").alias("p"), F.col("na").alias("n"), "shared"))
        loose = inside.where("not linked").join(partners.hint("merge"), "g").where(alike(F.col("shared"), "size", "n"))
        out = out.unionByName(loose.select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b")))
    out = written(out, "links")
    return out if links is None else links.unionByName(out)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared / (x.n + y.n - shared) >= 0.8
  UNION ALL SELECT b, a FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared / (x.n + y.n - shared) >= 0.8),
c(node, class) USING KEY (node) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT t.node, t.class FROM (SELECT e.b AS node, min(c.class) AS class FROM c JOIN e ON e.a = c.node GROUP BY 1) t
  JOIN recurring.c r ON r.node = t.node WHERE t.class < r.class)
SELECT node AS doc_id, class AS class_id, count(*) OVER (PARTITION BY class) AS class_size FROM c
"""
