"""Language identification: averaged hashed subword embeddings with a linear softmax."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriledge.llm.common import giving_back, slices, unit_hash
from veriledge.llm.subwords import add_by_owner, blocks, grams

BUCKETS, SIZES = 1 << 16, (2, 3, 4)


@dataclass
class LanguageModel:
    """``table`` is embeddings times output weights: a text's logits are the mean of its rows."""

    languages: list
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _counts(texts):
    """(buckets, weights) per text, weights adding up to 1; six bytes a bucket."""
    out = []
    for begin in range(0, len(texts), 64):
        part = texts[begin:begin + 64]
        found = [[] for _ in part]
        for points, owner in blocks(part):
            for n in SIZES:
                bucket, own = grams(points, owner, n, BUCKETS)
                cut = np.searchsorted(own, np.arange(len(part) + 1))
                for i in np.unique(own):
                    found[i].append(bucket[cut[i]:cut[i + 1]].astype(np.uint16))
        for parts in found:
            ids, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint16),
                               return_counts=True)
            out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def _segments(text: str, words=(2, 5, 15, 60)):
    """The whole text and shorter runs of its words, so short texts are learnt too."""
    yield text
    parts = text.split()
    for k, n in enumerate(words):
        if len(parts) > n:
            at = (len(parts) - n) * (k + 1) // (len(words) + 1)
            yield " ".join(parts[at:at + n])


def fit(rows, dim: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 4,
        keep: float = 0.999) -> LanguageModel:
    """Stochastic gradient descent over (text, language) pairs.

    A fifth of the pairs is held back: they set the temperature of the softmax, and the score
    below which a prediction is rejected, so that a share ``keep`` of the right ones stays.
    """
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 1.0)
    place = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    texts, labels, held = [], [], []
    for i, (text, lang) in enumerate(rows):
        for piece in _segments(text):
            texts.append(piece)
            labels.append(place[lang])
            held.append(i % 5 == 4)
    bags, labels, held = _counts(texts), np.array(labels), np.array(held)
    if held.all() or not held.any():
        held[:] = False
    full = np.array([len(ids) > 0 for ids, _ in bags])
    train = np.flatnonzero(full & ~held)
    embed = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, weight = bags[i]
            hidden = weight @ embed[ids]
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[labels[i]] -= 1
            now = rate * (1 - step / steps)
            back = out @ p
            out -= now * np.outer(hidden, p)
            bias -= now * p
            # Averaging leaves tiny gradients per bucket; they are scaled by the bag's size.
            embed[ids] -= now * np.outer(weight * len(ids), back)
            step += 1
    table = embed @ out
    check = np.flatnonzero(full & (held if held.any() else ~held))
    logits = np.array([bags[i][1] @ table[bags[i][0]] + bias for i in check])
    truth = labels[check]

    def scored(t):
        z = logits / t
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    # Smoothed targets: where every prediction is right, the softmax must not harden without end.
    smooth = len(languages) / (len(truth) + 2.0)

    def loss(t):
        logs = np.log(scored(t) + 1e-12)
        return -((1 - smooth) * logs[np.arange(len(truth)), truth]
                 + smooth * logs.mean(axis=1)).mean()

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
    temperature = float(min(grid, key=loss)) if len(check) else 1.0
    p = scored(temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    threshold = float(np.quantile(right, 1 - keep)) if len(right) else 1.0
    # Never stricter than a bare majority of the probability.
    return LanguageModel(languages, table.astype(np.float32), bias, temperature,
                         min(threshold, 0.5))


def held_out(key: Column, parts: int, part: int) -> Column:
    """Fold of a row by the checksum of its key's text; a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts)) == part


def training_rows(docs: DataFrame, per_language: int = 500, longest: int = 200_000):
    """A sample of about ``per_language`` labelled learning rows of each language, by row hash.

    Texts of more than ``longest`` characters are not learnt from, which bounds the sample's bytes.
    """
    learn = docs.where("lang is not null and text is not null").where(
        F.length(F.col("text").cast("string")) <= longest).where(
        ~held_out(F.col("doc_id"), 3, 1)).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        unit_hash(4, F.col("doc_id").cast("string"), F.length("text")).alias("u"))
    shares = {r["lang"]: per_language / r["n"] for r in
              learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return []
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    picked = learn.where(F.col("u") < share).select("text", "lang").collect()
    return sorted((r["text"], r["lang"]) for r in picked)


def predict(texts, model) -> tuple:
    """(languages, scores, whether rejected) of a list of texts by the model's plain values."""
    languages, table, bias, temperature, threshold = model
    total = np.zeros((len(texts), len(bias)), np.float64)
    count = np.zeros((len(texts), 1))
    for points, owner in blocks(texts):
        for n in SIZES:
            bucket, own = grams(points, owner, n, BUCKETS)
            add_by_owner(total, table[bucket], own)
            add_by_owner(count, np.ones((len(own), 1)), own)
    logits = (total / np.maximum(count, 1) + bias) / temperature
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    known = (count[:, 0] > 0) & (len(languages) > 0)
    best = p.argmax(axis=1)
    score = np.where(known, p.max(axis=1), 0.0)
    names = [languages[b] if k else "und" for b, k in zip(best, known)]
    return names, score, ~known | (score < threshold)


def sent_model(docs: DataFrame, model: LanguageModel):
    """The model as plain values: executors need no installed copy of this module to read them."""
    return docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.table, model.bias, model.temperature, model.threshold))


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` whose language is not rejected, in one pass without a shuffle."""
    sent, place = sent_model(docs, model), docs.columns.index("text")

    def keep(batches):
        for batch in slices(batches):
            texts = [None if t is None else str(t) for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(~predict(texts, sent.value)[2]))

    return docs.mapInArrow(lambda batches: giving_back(keep(batches)), docs.schema)


def language_ids(docs: DataFrame, per_language: int = 500) -> DataFrame:
    """Learn from the learning folds and predict every document: doc_id, held_out, lang_pred, score.

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null or has no
    letter, or nothing could be learned. ``rejected`` marks those and scores below the calibrated
    threshold. Language, source and key are never inputs of a prediction; repeated rows get the
    same result each. An empty table gives no rows.
    """
    model = fit(training_rows(docs, per_language))
    sent = sent_model(docs, model)

    def score(batches):
        for batch in slices(batches):
            names, scores, rejected = predict(batch.column(1).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(lambda batches: giving_back(score(batches)),
                             "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"),
                        "lang_pred", "score", "rejected")
