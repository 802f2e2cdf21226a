"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriledge.llm.common import slices, stored, unit_hash
from veriledge.llm.lang_id import held_out
from veriledge.llm.subwords import blocks, grams

BUCKETS, SIZES = 1 << 18, (3, 4, 5)
CUT = 0.3


@dataclass
class ToxicModel:
    """``weights`` holds ratio times learned weight of each bucket; absent n-grams count 0."""

    weights: np.ndarray
    bias: float


def presence(texts, wanted=None):
    """(text number, bucket) of the distinct n-grams of each text, as two arrays.

    With ``wanted`` only buckets it marks are kept, before the sort.
    """
    keys = []
    for points, owner in blocks(texts):
        for n in SIZES:
            bucket, own = grams(points, owner, n, BUCKETS)
            if wanted is not None:
                pick = wanted[bucket]
                bucket, own = bucket[pick], own[pick]
            keys.append(np.unique(own.astype(np.int64) * BUCKETS + bucket))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key // BUCKETS, key % BUCKETS


def log_ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Smoothed log-count ratios, drawn towards 0 by three standard errors.

    A long text holds thousands of n-grams; without the shrinkage their chance ratios would add up
    to more than those of the few n-grams that matter.
    """
    ratio = np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))
    error = np.sqrt(1 / (pos + 1) + 1 / (neg + 1))
    return np.sign(ratio) * np.maximum(0, np.abs(ratio) - 3 * error)


def fit_linear(rows, labels, ratios, prior: float, epochs: int = 15, rate: float = 0.3,
               decay: float = 1e-4, seed: int = 7) -> ToxicModel:
    """Logistic regression on ratio-scaled presence, by AdaGrad; ``rows`` hold bucket arrays.

    Classes weigh the same while learning; the bias is then set back to the corpus's ``prior``.
    """
    labels = np.asarray(labels, float)
    # Starting at 1 is the naive Bayes classifier itself.
    weight, bias = np.ones(BUCKETS, np.float64), 0.0
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(np.clip(prior, 1e-4, 1 - 1e-4))
        return ToxicModel(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    square, square_bias = np.full(BUCKETS, 1e-2), 1e-2
    share = labels.mean()
    cost = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            ids = rows[i]
            x = ratios[ids]
            z = float(np.clip(weight[ids] @ x + bias, -30, 30))
            gap = (1 / (1 + np.exp(-z)) - labels[i]) * cost[i]
            grad = gap * x + decay * (weight[ids] - 1)
            square[ids] += grad * grad
            weight[ids] -= rate * grad / np.sqrt(square[ids])
            square_bias += gap * gap
            bias -= rate * gap / np.sqrt(square_bias)
    odds = float(np.clip(prior, 1e-4, 1 - 1e-4))
    return ToxicModel((weight * ratios).astype(np.float32), bias + float(np.log(odds / (1 - odds))) / 2)


def learn(docs: DataFrame, labels: DataFrame, per_class: int = 10_000) -> ToxicModel:
    """Fit on about ``per_class`` labelled learning rows of each class, picked by row hash.

    Only that bounded list of keys is broadcast; n-gram counts of its texts are made on the
    executors, per task and then per bucket. Several labels of a document count as their largest.
    """
    known = (labels.where("toxic in (0, 1) and doc_id is not null")
             .where(~held_out(F.col("doc_id"), 4, 2))
             .groupBy(F.col("doc_id").cast("long").alias("k"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in
             known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return fit_linear([], [], None, 0.0)
    share = F.when(F.col("toxic") == 1, F.lit(per_class / sizes.get(1, 1))).otherwise(
        F.lit(per_class / sizes.get(0, 1)))
    picked = known.where(unit_hash(7, F.col("k")) < share)
    sample = stored(docs.select(F.col("doc_id").cast("long").alias("k"),
                                F.col("text").cast("string").alias("text"))
                    .join(F.broadcast(picked), "k").select("toxic", "text", "k"), "toxic-sample")

    def count(batches):
        sums = np.zeros((2, BUCKETS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in slices(batches):
            toxic = np.array(batch.column(0).to_pylist(), np.int64)
            who, bucket = presence(batch.column(1).to_pylist())
            np.add.at(sums, (toxic[who], bucket), 1)
            rows += np.bincount(toxic, minlength=2)
        ids = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.r_[ids, -1]), pa.array(np.r_[sums[1, ids], rows[1]]),
            pa.array(np.r_[sums[0, ids], rows[0]])], names=["bucket", "pos", "neg"])

    # One row per bucket at most: the dimension is fixed.
    counted = (sample.select("toxic", "text").mapInArrow(count, "bucket long, pos long, neg long")
               .groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow())
    bucket, more, less = (counted[c].to_numpy() for c in ("bucket", "pos", "neg"))
    pos, neg, ends = np.zeros(BUCKETS), np.zeros(BUCKETS), bucket < 0
    pos[bucket[~ends]], neg[bucket[~ends]] = more[~ends], less[~ends]
    if not ends.any():
        return fit_linear([], [], None, sizes.get(1, 0) / total)
    ratios = log_ratios(pos, neg, int(more[ends].sum()), int(less[ends].sum()))
    sent = docs.sparkSession.sparkContext.broadcast(ratios != 0)

    def features(batches):
        for batch in slices(batches):
            who, bucket = presence(batch.column(1).to_pylist(), sent.value)
            cut = np.searchsorted(who, np.arange(batch.num_rows + 1)).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(cut), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), ids],
                                             names=["toxic", "k", "ids"])

    rows = (sample.select("toxic", "text", "k").mapInArrow(features, "toxic int, k long, ids array<int>")
            .orderBy("k", "toxic").toArrow().combine_chunks())
    ids = rows["ids"].combine_chunks()
    cut, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    bags = [flat[a:b] for a, b in zip(cut[:-1], cut[1:])]
    return fit_linear(bags, rows["toxic"].to_pylist(), ratios, sizes.get(1, 0) / total)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 10_000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, by its whole text alone.

    Null and empty texts are scored too, by the bias. Without any learning label every score is
    near 0. Repeated rows get the same score each; other columns are ignored. An empty table gives
    no rows.
    """
    model = learn(docs, labels, per_class)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def score(batches):
        weights, bias = sent.value
        wanted = weights != 0
        for batch in slices(batches):
            who, bucket = presence(batch.column(1).to_pylist(), wanted)
            z = np.bincount(who, weights[bucket], minlength=batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
