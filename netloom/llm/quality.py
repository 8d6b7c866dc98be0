"""Text quality by naive Bayes support vectors.

Features are indicators of n-grams, hashed into DIMENSIONS: single words (lower-cased in A-Z) and runs of one to
three word shapes. A shape holds a word's case pattern, its digits, its last byte if that is no letter, its length class
and whether it repeats the word before. Each indicator is scaled by its class log-count ratio, each document's
vector to length 1, and a linear classifier with hinge loss is fitted by dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.store import columns_of, small_batches
from netloom.llm.textops import U, Words, chunks, list_column, mix

BITS = 18
DIMENSIONS = 1 << BITS
TRAIN_PER_CLASS = 2000

_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.uint8)
_LOWER[97:123] = 1
_DIGIT = np.zeros(256, np.uint8)
_DIGIT[48:58] = 1
_WIDE = np.zeros(256, np.uint8)
_WIDE[128:] = 1


def features(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), distinct and sorted, for the texts of a chunk."""
    w = Words(offsets, data, lower=True)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def total(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        return sums[w.end] - sums[w.start]

    length = w.end - w.start
    upper, lower, digit, wide = total(_UPPER), total(_LOWER), total(_DIGIT), total(_WIDE)
    first, last = data[w.start], data[w.end - 1]
    case = np.where(upper + lower + wide == 0, 0, np.where(upper == 0, 1, np.where(lower > 0, np.where((upper == 1) & (_UPPER[first] == 1), 2, 3), 4)))
    ending = np.where((_UPPER[last] | _LOWER[last] | _DIGIT[last] | _WIDE[last]) == 1, 0, last.astype(np.int64))
    again = np.concatenate([[False], w.hash[1:] == w.hash[:-1]]) & (np.arange(len(w.hash)) > w.first[w.doc])
    shape = ((case * 256 + ending) * 8 + np.minimum(np.log2(length).astype(np.int64), 7)) * 4 + (digit > 0) * 2 + again
    shape = mix(shape.astype(U) + U(1))
    top = U(64 - BITS)
    keys = [w.doc << BITS | (mix(w.hash + U(11)) >> top).astype(np.int64)]
    run = shape
    for k in (1, 2, 3):
        if k > 1:
            if len(shape) < k:
                break
            run = mix(run[:-1] * U(0x9E3779B97F4A7C15) + shape[k - 1 :])
        same = w.doc[: len(run)] == w.doc[k - 1 :]
        keys.append((w.doc[: len(run)] << BITS | (mix(run + U(k)) >> top).astype(np.int64))[same])
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key >> BITS, key & (DIMENSIONS - 1)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, doc: np.ndarray, feature: np.ndarray, docs: int) -> np.ndarray:
        r = self.ratio[feature]
        norm = np.sqrt(np.bincount(doc, r * r, docs))
        dot = np.bincount(doc, r * self.weight[feature], docs)
        margin = np.divide(dot, norm, out=np.zeros(docs), where=norm > 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(2 * margin, -50, 50)))


def fit(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0, cost: float = 4.0, epochs: int = 30, seed: int = 7) -> Model:
    """Dual coordinate descent for the L1-loss support vector machine on ratio-scaled indicators.

    rows: the features of each document; labels: 0 or 1. The two classes' costs are balanced. Without documents, or with one
    class only, all weights are 0 and the bias says that class (1 without any).
    """
    y = np.where(labels == 1, 1.0, -1.0)
    count = [np.full(DIMENSIONS, smooth), np.full(DIMENSIONS, smooth)]
    for x, label in zip(rows, labels, strict=True):
        count[int(label)][x] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    ratio -= np.log((smooth / count[1].sum()) / (smooth / count[0].sum()))  # unseen features say nothing
    weight, bias = np.zeros(DIMENSIONS), 0.0
    if len(set(y)) < 2:
        return Model(ratio * 0, weight, -1.0 if len(y) and y[0] < 0 else 1.0)
    most = {s: cost * len(y) / (2 * (y == s).sum()) for s in (1.0, -1.0)}
    values = [(v := ratio[x]) / max(np.sqrt(v @ v), 1e-12) for x in rows]
    alpha, rng = np.zeros(len(y)), np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            slope = y[i] * (weight[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), most[y[i]])  # |x|^2 is 1, and 1 for the bias
            step = new - alpha[i]
            if step:
                alpha[i] = new
                weight[x] += step * y[i] * v
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return Model(ratio, weight, bias)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model:
    """docs (doc_id, text), labels (doc_id, label 0 or 1) -> Model, from at most about per_class labels of each class.

    These are the ones of the smallest hashes of doc_id; null labels are left out. The sample is drawn from the
    labels alone and broadcast, so that no text is shuffled; the driver gets the sample's hashed features only.
    per_class is the bound on both.
    """
    small_batches(spark)
    own = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("label in (0, 1)")
    sizes = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, per_class / n)).otherwise(share)
    sample = own.where(F.xxhash64(F.col("doc_id"), F.lit(5)) / 2.0**64 + 0.5 <= share)
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, offsets, data in chunks(batch):
                doc, feature = features(offsets, data)
                sizes = np.bincount(doc, minlength=end - row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), list_column(feature.astype(np.int32), sizes, pa.int32())], ["doc_id", "label", "features"])

    found = own.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, features array<int>").toArrow().sort_by("doc_id")
    rows = [np.asarray(x, np.int64) for x in found.column("features").to_pylist()]
    return fit(rows, found.column("label").to_numpy())


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, score), one row for each row of docs: 0 to 1, higher for label 1.

    Whole texts are scored. Null and empty texts have no features, so the model's bias decides. Rows are judged one by
    one, so repeats and further columns change nothing. The model is of fixed size and broadcast.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, offsets, data in chunks(batch):
                doc, feature = features(offsets, data)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(shared.value.scores(doc, feature, end - row))], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least `least`; null and empty texts are judged by the bias."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(0).field("text")], ["text"])
            for row, end, offsets, data in chunks(texts):
                doc, feature = features(offsets, data)
                good = shared.value.scores(doc, feature, end - row) >= least
                if good.any():
                    yield batch.slice(row, end - row).filter(pa.array(good))

    rows = docs.select(F.struct(*columns_of(docs)).alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
