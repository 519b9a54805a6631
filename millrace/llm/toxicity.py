"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (P) and a sample of the labelled documents whose labels are set aside (U, of unknown labels, with the class
prior that the labels have) train a linear classifier over the presence of words and word beginnings.
With the class prior pi and the logistic loss l, the risk is pi E_P[l(g)] + max(0, E_U[l(-g)] - pi E_P[l(-g)]): what the
positives within U add to the loss is taken off, and where that makes the second term negative, which only overfitting can, the step
goes the other way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held_out, seeded, table, written
from millrace.llm.shingles import distinct, shingle_hashes, slices

_WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """The distinct lower-case words, and their first four and five letters, which inflected forms share, with a star."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:4] + "*" for w in words} | {w[:5] + "*" for w in words}


def copy_keys(texts: pa.Array) -> list[str]:
    """For each text its three least shingle hashes (all, if it has fewer). Two texts of similarity s of their five-word shingles agree in them with a probability
    of about s**3: copies with small changes mostly do, texts that only share a passage hardly ever, others never."""
    out: list[str] = []
    for start, n in slices(texts):
        h, row, _ = distinct(*shingle_hashes(texts.slice(start, n)))
        cuts = np.searchsorted(row, np.arange(n + 1))
        out += [" ".join(map(str, h[cuts[i] : min(cuts[i] + 3, cuts[i + 1])].tolist())) for i in range(n)]
    return out


@dataclass
class ToxicityModel:
    place: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        known = self.place.keys() & features_of(text)
        g = self.bias + sum(self.weights[self.place[w]] for w in sorted(known))
        return float(1 / (1 + np.exp(-np.clip(g, -700, 700))))


def nonnegative_fit(rows: list[list[int]], positive: np.ndarray, features: int, prior: float, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Minimises the non-negative risk by Adam over all rows at once. rows: places of the features that are present; positive: which are of P, the others are of U."""
    lengths = np.array([len(r) for r in rows])
    flat = np.fromiter((f for r in rows for f in r), np.int64, int(lengths.sum()))
    row = np.repeat(np.arange(len(rows)), lengths)
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    w = np.zeros(features + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = np.bincount(row, w[flat], len(rows)) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(g, -50, 50)))  # d l(-g) / dg; d l(g) / dg = s - 1
        loss = np.logaddexp(0, g)
        negative = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
        d_negative = np.where(positive, -prior * s / n_p, s / n_u)
        d = -d_negative if negative < 0 else np.where(positive, prior * (s - 1) / n_p, 0) + d_negative
        grad = np.append(np.bincount(flat, d[row], features), d.sum())
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 4000, max_unlabelled: int = 12_000, margin: float = 6.0, seed: int = 11) -> ToxicityModel:
    """Learns from labelled rows whose id is not held out. An id labelled more than once has the largest label; labels other than 0 and 1 don't count.

    Bounds of the labelled sample: of the toxic ids the ``max_positive`` of smallest hash are P, of all labelled ids the ``max_unlabelled``
    of smallest hash are U. Features are all those whose document counts in P and U differ beyond chance: the G statistic must exceed, by
    ``margin``, what the largest of as many chance features reaches (twice the logarithm of their number); and the words of three documents or more that begin
    with one of them. In the statistic, copies
    within P or U, as told by ``copy_keys``, count once, or the words of one document that many copy would pass for signs of toxicity; the fit is over
    all rows. The class prior is the toxic share of U's labels, which are used for nothing else of U. Without positives, every score is 0. Null and empty texts have no feature. Rows of docs that
    repeat an id all count. Other columns are not read.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not toxic:
        return ToxicityModel({}, np.zeros(0), -700.0)
    prior = min(max(toxic / n, 1e-4), 0.9)
    nearest = lambda ids, k: ids.orderBy(seeded(F.col("id"), seed), "id").limit(k)
    positive = nearest(known.where("label = 1"), max_positive).withColumn("p", F.lit(1))
    every = nearest(known, max_unlabelled).withColumn("p", F.lit(0))
    wanted = written(positive.unionByName(every), "toxic-sample")
    kind = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                words = pa.array([sorted(features_of(t)) for t in part.column(3).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(copy_keys(part.column(3)), pa.string()), words], names=["id", "p", "label", "copy", "words"])

    # Broadcast: max_positive + max_unlabelled ids at most.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "id").select("id", "p", "label", "text")
    texts = rows.mapInArrow(split, f"id {kind}, p int, label int, copy string, words array<string>")
    sample = written(texts, "toxic-words")
    sizes = {r["p"]: r for r in sample.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"), F.countDistinct("copy").alias("copies")).collect()}
    if len(sizes) < 2:
        return ToxicityModel({}, np.zeros(0), float(np.log(prior / (1 - prior))) if 0 in sizes else -700.0)
    prior = min(max(sizes[0]["toxic"] / sizes[0]["n"], 1e-4), 0.9)
    n_p, n_u = sizes[1]["copies"], sizes[0]["copies"]
    once = sample.groupBy("p", "copy").agg(F.min(F.struct("id", "words")).alias("one")).select("p", F.explode("one.words").alias("word"))
    counts = written(once.groupBy("word").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b")).where("a + b >= 3"), "toxic-counts")
    rate = (F.col("a") + F.col("b")) / (n_p + n_u)
    term = lambda k, size, p: F.when(k > 0, k * F.log(k / (size * p))).otherwise(0.0) + F.when(size > k, (size - k) * F.log((size - k) / (size * (1 - p)))).otherwise(0.0)
    gain = 2 * (term(F.col("a"), F.lit(n_p), rate) + term(F.col("b"), F.lit(n_u), rate))
    counts = counts.where(rate < 1)
    least = 2 * np.log(max(1, counts.count())) + margin
    counts = counts.withColumn("gain", gain).where(F.col("gain") >= float(least))
    chosen = [r["word"] for r in counts.orderBy(F.desc("gain"), "word").select("word").collect()]
    # A word that continues a chosen beginning may mean something else, which all rows that hold it tell, copies too.
    every_word = sample.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    begins = F.concat(F.substring("word", 1, 4), F.lit("*")).isin(chosen) | F.concat(F.substring("word", 1, 5), F.lit("*")).isin(chosen)
    more = [r["word"] for r in every_word.where((F.col("n") >= 3) & ~F.col("word").endswith("*") & begins).orderBy("word").select("word").collect()] if chosen else []
    place = {w: i for i, w in enumerate(dict.fromkeys([*chosen, *more]))}

    def known_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[w] for w in words if w in place) for words in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "p", "features"])

    # Rows of the bounded sample, with the chosen features only.
    rows = sample.select("id", "p", "words").mapInArrow(known_words, f"id {kind}, p int, features array<int>").orderBy("p", "id").collect()
    weights, bias = nonnegative_fit([r["features"] for r in rows], np.array([r["p"] == 1 for r in rows]), len(place), prior)
    return ToxicityModel(place, weights, bias)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row, from the whole text. An empty or null text has the score of no known word. Repeated rows are scored each; other columns,
    whatever their names, are not read; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t) for t in part.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
