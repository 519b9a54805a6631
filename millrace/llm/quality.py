"""Quality by regularised quadratic discriminant analysis of document statistics.

A document is a vector of transformed statistics of its whole text. Each class is a Gaussian whose covariance is shrunk towards
the pooled one and that towards a sphere. The score is the posterior from the difference of the two log densities; their
Mahalanobis distances use Cholesky factors that are computed once and kept in the model.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held_out, table, written

STATISTICS = ("log_words", "word_length", "distinct_words", "top_word", "upper", "digits", "symbols", "bars", "stops", "commas", "lines", "line_words", "repeated_lines", "packed", "non_ascii", "odd_ends")
_SYMBOLS = np.array([ord(c) for c in "!\"#$%&*+/<=>?@\\^_`{}~[]"])
_ODD = tuple("!#$%&*+/<=>@\\^_`{|}~")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics, in the order of STATISTICS. Null counts as empty, whose shares are all 0."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(data))
    seen = Counter(words)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    root = lambda a, b: math.sqrt(a / max(1, b))
    odd = sum(k for w, k in seen.items() if w.endswith(_ODD))
    return [
        math.log1p(len(words)),
        math.log1p(len(text) / n),
        len(seen) / n,
        root(max(seen.values(), default=0), n),
        root(upper, upper + lower),
        root(int(counts[48:58].sum()), size),
        root(int(counts[_SYMBOLS].sum()), size),
        root(int(counts[124]), size),
        root(int(counts[46]), n),
        root(int(counts[44]), n),
        math.log1p(len(lines)),
        math.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log(size / len(zlib.compress(data, 1))),
        root(int(counts[192:].sum()), size),
        root(odd, n),
    ]


@dataclass
class QualityModel:
    """Of the two classes: log prior, mean, inverse-free Cholesky factor and half the log determinant, over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    log_prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    half_log_det: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row of statistics."""
        if not np.isfinite(self.log_prior).all():  # a class was never seen
            return np.full(len(x), 0.5 if not np.isfinite(self.log_prior).any() else float(np.isfinite(self.log_prior[1])))
        z = (x - self.centre) / self.scale
        density = []
        for c in (0, 1):
            white = np.linalg.solve(self.factor[c], (z - self.mean[c]).T)
            density.append(self.log_prior[c] - self.half_log_det[c] - 0.5 * np.einsum("ij,ij->j", white, white))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(n: np.ndarray, total: np.ndarray, square: np.ndarray, own: float = 0.7, sphere: float = 0.05) -> QualityModel:
    """From the classes' counts, sums and sums of outer products. own: weight of a class's covariance against the pooled; sphere: of the sphere."""
    d = total.shape[1]
    everything = max(1.0, float(n.sum()))
    centre = total.sum(axis=0) / everything
    scale = np.sqrt(np.maximum(np.diagonal(square.sum(axis=0)) / everything - centre**2, 1e-6))
    mean, cov = np.zeros((2, d)), np.zeros((2, d, d))
    for c in (0, 1):
        if n[c]:
            m = total[c] / n[c]
            mean[c] = (m - centre) / scale
            cov[c] = (square[c] / n[c] - np.outer(m, m)) / np.outer(scale, scale)
    pooled = (cov * n[:, None, None]).sum(axis=0) / everything
    factor = np.zeros((2, d, d))
    for c in (0, 1):
        weight = own * n[c] / (n[c] + d)
        mixed = weight * cov[c] + (1 - weight) * pooled
        factor[c] = np.linalg.cholesky((1 - sphere) * mixed + sphere * max(1e-3, np.trace(mixed) / d) * np.eye(d))
    with np.errstate(divide="ignore"):
        return QualityModel(centre, scale, np.log(n / everything), mean, factor, np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(axis=1))



def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) per row, x the statistics of the whole text; a null text counts as empty. Repeated rows are measured each; other columns, whatever
    their names, are not read; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t) for t in part.column(1).to_pylist()], pa.list_(pa.float64()))], names=["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, x array<double>")


def train(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fits the classes from all measured rows with a label 0 or 1 whose id is not held out. An id labelled more than once has the largest label.
    Rows that repeat an id all count. If only one class was seen, scores are its label; if none was, 0.5. Other columns are not read."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = measured.where(~held_out(F.col("id"))).join(known, "id").select("label", "x")
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            label, x = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
            for c in set(label.tolist()):
                own = x[label == c]
                sums[c] = sums.get(c, 0) + np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for c, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array(s)], names=["label", "at", "value"])

    got = rows.mapInArrow(run, "label int, at int, value double").groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros((2, 1 + d + d * d))
    for r in got:
        sums[r["label"], r["at"]] = r["value"]
    return fit(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def score_quality(measured: DataFrame, model: QualityModel) -> DataFrame:
    """(id, score) per measured row: the probability that the label is 1. Empty texts are scored by their statistics like any other."""
    kind = measured.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(np.array(batch.column(1).to_pylist())))], names=["id", "score"])

    return measured.mapInArrow(run, f"id {kind}, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = written(measure(table(spark, sf_dir, "documents")), "statistics")
    scored = score_quality(measured, train(measured, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
