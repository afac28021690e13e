"""Toxicity scores by a linear classifier on character n-grams.

Every n-gram that occurs in a text is a hashed 0/1 feature, scaled by its naive
Bayes log-count ratio between toxic and clean training texts. A logistic
regression on the scaled features is fitted on a bounded sample of labelled rows
and applied to every whole text inside Spark tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import mapped, table

#: Most labelled rows of either class that the fit uses.
SAMPLE_PER_CLASS = 3_000
ORDERS = (3, 4, 5)
BITS = 18
SMOOTHING = 1.0
EPOCHS = 12
RATE = 0.05
DECAY = 1e-3
WINDOW = 1 << 20
FOLDS, HELD = 5, 0


def fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def hashed(codes: np.ndarray, order: int) -> np.ndarray:
    """Bucket of each n-gram of ``order`` code points."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    mixed = np.full(n, order, np.uint64)
    for k in range(order):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


class Presence:
    """Distinct buckets of whole texts, read in windows so that memory stays small."""

    def __init__(self):
        self._seen = np.zeros(1 << BITS, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        text = f" {(text or '').lower()} "
        for start in range(0, len(text), WINDOW):
            window = text[start : start + WINDOW + max(ORDERS) - 1]
            codes = np.frombuffer(window.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
            for order in ORDERS:
                self._seen[hashed(codes, order)] = True
        found = np.flatnonzero(self._seen)
        self._seen[found] = False
        return found


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        """Sums are divided by the root of the number of features, as in the fit."""
        z = self.bias + self.weights[buckets].sum() / np.sqrt(len(buckets) + 1)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: list[int]) -> Model:
    """Log-count ratios, then logistic regression on the scaled features by averaged
    stochastic gradient steps in a fixed order. Without both classes the score is
    the share of toxic rows (one half without any)."""
    size = 1 << BITS
    labels = np.array(labels, dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(size), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    counts = [SMOOTHING + np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k]), minlength=size) for k in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    weights, slopes, total = np.zeros(size), np.full(size, 1e-6), np.zeros(size)
    bias, steps, mean_bias = 0.0, 0, 0.0
    order = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        for k in order.permutation(len(rows)):
            x = rows[k]
            scaled = ratio[x] / np.sqrt(len(x) + 1)
            p = 1 / (1 + np.exp(-np.clip(bias + weights[x] @ scaled, -30, 30)))
            error = p - labels[k]
            slope = error * scaled + DECAY * weights[x]
            slopes[x] += slope * slope
            weights[x] -= RATE * slope / np.sqrt(slopes[x])
            bias -= RATE * 0.1 * error
        if epoch >= EPOCHS // 2:
            total += weights
            mean_bias += bias
            steps += 1
    return Model(total / steps * ratio, mean_bias / steps)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on at most about ``sample`` hash-chosen rows of either class outside the held-out fold.

    Labels other than 0 and 1, null ids and ids without a document are ignored; of
    repeated ids the largest label counts.
    """
    marks = (
        labels.filter(F.col("toxic").isin(0, 1) & (fold(FOLDS) != HELD))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col("toxic") == label, F.lit(min(1.0, sample / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)
    chosen = marks.filter(drawn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * sample)
    keys = docs.sparkSession.createDataFrame(chosen.toPandas().astype("int64"), "doc_id long, toxic long")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Presence()
        for batch in batches:
            found = [buckets(t.as_py()).astype(np.int32).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "toxic", "buckets"]
            )

    texts = docs.select("doc_id", "text").join(F.broadcast(keys), "doc_id").select("doc_id", "toxic", "text")
    rows = mapped(texts, presence, "doc_id long, toxic long, buckets binary").toPandas().sort_values(["doc_id", "buckets"])
    return fit([np.frombuffer(b, np.int32) for b in rows["buckets"]], rows["toxic"].tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    A null text is scored as an empty one, a null doc_id is not held out, repeated
    rows give equal rows, other columns are ignored, and an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Presence()
        for batch in batches:
            found = np.array([model.score(buckets(t.as_py())) for t in batch.column(2)], dtype=np.float64)
            columns = [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(FOLDS) == HELD, F.lit(False)).alias("held_out")
    return mapped(docs.select("doc_id", held, "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every text of the whole table ``documents``, learned from ``labels`` outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
