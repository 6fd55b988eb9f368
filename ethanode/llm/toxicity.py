"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's n-grams, of several lengths and in hashed buckets, have the values log(1 + count),
over the text's length where it is long. Each bucket's log-count ratio is the logarithm of its
smoothed share of the toxic texts over its share of the others; the buckets that tell the
classes apart best are features, scaled by their ratios, and a logistic model with an elastic
penalty weighs them. What is left is one weight for each bucket that counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lengths of the n-grams, and buckets that they are hashed to.
LENGTHS = (3, 4, 5, 6, 7)
BUCKETS = 1 << 21
#: Features of the linear model: the buckets with the most telling ratios.
FEATURES = 2_000
#: Labelled rows that the fit uses at most, about.
TRAIN_ROWS = 12_000
#: Characters read at a time of a long text.
CHUNK = 1 << 20
#: Characters from which a text counts as long: further ones lower the values of what it holds.
LONG = 2_000
#: The bounded training rows are fitted in so many partitions: each step of a fit is a job, and up to four are summed in one stage.
FIT_PARTITIONS = 4

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """slots: for each bucket 0, or 1 + the number of its weight; so a text's score is a sum over its slots."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float
    lengths: tuple[int, ...]


def grams(text: str, lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS):
    """Buckets of the n-grams of a text, an array for each length and chunk; lower case, white space as one space, one on each side too."""
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    for at in range(0, max(len(codes) - 1, 1), CHUNK):
        part = codes[at : at + CHUNK + max(lengths) - 1]
        own = min(len(part), CHUNK)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(lengths) + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] * _FACTOR) + part[n - 1 :] + np.uint64(1)
            h = h ^ (h >> np.uint64(29))
            if n in lengths:
                yield ((h[:own] * _FACTOR) >> np.uint64(40)).astype(np.int64) % buckets


def values(counts: np.ndarray, chars: int) -> np.ndarray:
    """Of n-grams found `counts` times in a text."""
    return np.log1p(counts * min(1.0, LONG / max(chars, 1)))


def class_counts(labelled: DataFrame, lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ones, zeros): texts of either label that hold each bucket's n-grams; one row a bucket at most."""

    def count(batches):
        ones, zeros = np.zeros(buckets, np.int32), np.zeros(buckets, np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = [np.unique(g) for g in grams(text or "", lengths, buckets)]
                if held:
                    (ones if label else zeros)[np.unique(np.concatenate(held))] += 1
        at = np.flatnonzero(ones + zeros)
        for lo in range(0, len(at), 50_000):
            some = at[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(ones[some], pa.int64()), pa.array(zeros[some], pa.int64())], names=["bucket", "ones", "zeros"])

    return labelled.select("__text", "__label").mapInArrow(count, "bucket long, ones long, zeros long").groupBy("bucket").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def log_count_ratio(ones, zeros, n_ones: int, n_zeros: int):
    """The logarithm of the smoothed shares of both classes' texts, over each other."""
    return F.log((ones + F.lit(1.0)) / F.lit(n_ones + 2.0)) - F.log((zeros + F.lit(1.0)) / F.lit(n_zeros + 2.0))


def chosen_features(counts: DataFrame, n_ones: int, n_zeros: int, features: int = FEATURES) -> list[tuple[int, float]]:
    """(bucket, ratio) of the `features` buckets that differ most between the classes, for the noise of their counts."""
    rated = counts.withColumn("ratio", log_count_ratio(F.col("ones"), F.col("zeros"), n_ones, n_zeros))
    noise = F.sqrt(1 / (F.col("ones") + 1.0) + 1 / (F.col("zeros") + 1.0))
    best = rated.where("ones + zeros > 2").orderBy((F.abs("ratio") / noise).desc(), "bucket").limit(features)
    return [(r["bucket"], r["ratio"]) for r in best.select("bucket", "ratio").collect()]


def _held(text: str, slots: np.ndarray, lengths: tuple[int, ...], n: int) -> np.ndarray:
    """The values of a text for the n weights."""
    counts = np.zeros(n, np.int64)
    for g in grams(text, lengths, len(slots)):
        found = slots[g]
        counts += np.bincount(found[found > 0] - 1, minlength=n)
    return values(counts, len(text))


def fit(labelled: DataFrame, lengths: tuple[int, ...] = LENGTHS, buckets: int = BUCKETS, features: int = FEATURES, penalty: float = 0.0005, mix: float = 0.2) -> Model:
    """The model of rows (__text, __label 0 or 1); with rows of one label only, or none, its score is that of the label or 0.5."""
    none = Model(np.zeros(buckets, np.int32), np.zeros(0), 0.0, lengths)
    sizes = {r["__label"]: r["count"] for r in labelled.groupBy("__label").count().collect()}
    n_ones, n_zeros = sizes.get(1, 0), sizes.get(0, 0)
    if not n_ones or not n_zeros:
        return none if n_ones == n_zeros else Model(none.slots, none.weights, 5.0 if n_ones else -5.0, lengths)
    chosen = chosen_features(class_counts(labelled, lengths, buckets), n_ones, n_zeros, features)
    if not chosen:
        return Model(none.slots, none.weights, float(np.log(n_ones / n_zeros)), lengths)
    slots, ratios = none.slots.copy(), np.array([r for _, r in chosen])
    slots[[b for b, _ in chosen]] = np.arange(1, len(chosen) + 1)
    shared = labelled.sparkSession.sparkContext.broadcast((slots, ratios))

    def scaled(batches):
        slots, ratios = shared.value
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):  # a row is as long as there are features
            rows = [_held(t or "", slots, lengths, len(ratios)) * ratios for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.float64())], names=["x", "label"])

    design = labelled.select("__text", "__label").mapInArrow(scaled, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").persist()
    try:
        model = LogisticRegression(elasticNetParam=mix, regParam=penalty, maxIter=80, standardization=False).fit(design)
    finally:
        design.unpersist()
        shared.unpersist()
    weights = model.coefficients.toArray() * ratios
    kept = np.flatnonzero(np.abs(weights) > 1e-9)
    slots[:] = 0
    slots[[chosen[i][0] for i in kept]] = np.arange(1, len(kept) + 1)
    return Model(slots, weights[kept], float(model.intercept), lengths)


def score_texts(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability that its label is 1. Null and empty texts get the score of a text without features."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # as many numbers as there are buckets, a parameter

    def score(batches):
        m = shared.value
        for batch in batches:
            sums = [m.intercept + float(_held(t or "", m.slots, m.lengths, len(m.weights)) @ m.weights) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(np.array(sums), -50, 50))), pa.float64())], names=[id_col, "score"])

    return df.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, score double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled documents: about `train_rows` of them, chosen by a hash of the id.

    Labels that are null or not 0 or 1 and ids with both labels are left out, repeated labels
    count once, repeated documents each count; ids that only one side has are not used.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where(F.col("__label").isin(0, 1) & F.col("__id").isNotNull())
    known = known.groupBy("__id").agg(F.min("__label").cast("int").alias("__label"), F.max("__label").cast("int").alias("__most")).where("__label = __most").drop("__most")
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_rows / max(n, 1))) + 1)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    rows = rows.select("__text", "__label").repartition(FIT_PARTITIONS).persist()
    try:
        return fit(rows)
    finally:
        rows.unpersist()


def train_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, score) for every document, learned as in `train`; repeated rows each come out, ids may be null, other columns of `docs` are not read."""
    return score_texts(docs, train(docs, labels, id_col, text_col, label_col, train_rows), id_col, text_col)
