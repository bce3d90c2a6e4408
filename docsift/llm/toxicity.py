"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is lower-cased and cut into words; single words, neighbouring pairs and pairs with
one word between them are hashed to buckets, each counted once a text.  Every coordinate has
its own learning rate, and the L1 term keeps most weights at exactly zero, so the model that
goes to the workers is a short list of (bucket, weight).  Training runs in one task on a
bounded sample of labelled rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, fold, mix64, texts_of
from .sampling import bounded_sample, one_text

BITS = 20
#: Labelled documents of each label in the sample at most (about), passes over them.
PER_LABEL, EPOCHS = 4000, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.5, 0.02
#: A text is predicted toxic from this score on.
THRESHOLD = 0.3

_PART = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_PAIR, _SKIP = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def _buckets(text: bytes, words: WordHash) -> np.ndarray:
    """Buckets of the words, pairs and skip-pairs of a text (repeats stay in)."""
    w = words.array(text.translate(_PART).split())
    parts = [mix64(w)]
    if len(w) > 1:
        parts.append(mix64(w[:-1] * _PAIR + w[1:]))
    if len(w) > 2:
        parts.append(mix64(w[:-2] * _SKIP + w[2:]))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for batch in batches:
        idx = [np.unique(_buckets(t, words)).astype(np.int32) for t in texts_of(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2),
                                          pa.array(idx, pa.list_(pa.int32()))],
                                         names=["label", "weight", "draw", "idx"])


def fit(rows: pd.DataFrame) -> dict:
    """Train on rows of label, weight, draw, idx; the weights that are not zero."""
    rows = rows.sort_values("draw", kind="stable")
    idx = [np.concatenate([[1 << BITS], i]).astype(np.int64) for i in rows["idx"]]  # last: the bias
    y, weight = rows["label"].to_numpy(float), rows["weight"].to_numpy(float)
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    l1 = np.full((1 << BITS) + 1, L1)
    l1[-1] = 0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0,
                        -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for d in rng.permutation(len(idx)):
            i = idx[d]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - y[d]) * weight[d]
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / ALPHA * w
            n[i] = more
    w = weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w[:-1])
    return {"idx": at.astype(np.int32), "weight": w[at], "bias": float(w[-1])}


def known_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, label`` (0 or 1) of the documents that may be learned from: folds other than 2."""
    return (labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 2))
            .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")))


def train(docs: DataFrame, known: DataFrame) -> dict:
    """The model from the texts of ``docs`` (doc_id, text) and the labels of ``known``.

    Labels are drawn at different rates; a row's weight undoes that, up to a factor, so
    that scores are probabilities under the labels' own shares.  Without any labelled text
    the model is empty and every score is 0.5.
    """
    shares = known.groupBy(F.col("label").alias("w_label")).agg(F.count("*").alias("n"))
    most = shares.agg(F.sum(F.least(F.col("n"), F.lit(PER_LABEL))).alias("drawn"), F.sum("n").alias("all"))
    shares = shares.crossJoin(most).select(  # one row for each label, times one row
        "w_label", (F.greatest(F.col("n") / PER_LABEL, F.lit(1.0)) * F.col("drawn") / F.col("all")).alias("weight"))
    sample = (bounded_sample(known, "label", PER_LABEL, 2 * PER_LABEL).join(shares, F.col("label") == F.col("w_label"))
              .select(F.col("doc_id").alias("s_id"), "label", "weight", "draw"))
    # the sample's size is bounded: its ids go to the texts
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("s_id"))
    drawn = one_text(drawn.select("s_id", "label", "weight", "draw", "text"), ["s_id", "label", "weight", "draw"])
    features = (drawn.select("label", "weight", "draw", "text")
                .mapInArrow(_features, "label int, weight double, draw long, idx array<int>"))
    model = (features.groupBy().applyInPandas(
        lambda r: pd.DataFrame({"model": [pickle.dumps(fit(r))]}), "model binary")).collect()
    return pickle.loads(model[0].model) if model else {"idx": np.empty(0, np.int32), "weight": np.empty(0), "bias": 0.0}


def _with_scores(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
    words, table = WordHash(), np.zeros(1 << BITS)
    table[model["idx"]] = model["weight"]
    for batch in batches:
        scores = []
        for text in texts_of(batch):
            b = _buckets(text, words)
            b = np.unique(b[table[b] != 0])
            scores.append(float(1 / (1 + np.exp(-np.clip(model["bias"] + table[b].sum(), -30, 30)))))
        yield batch, scores


def _scored(batches: Iterator[pa.RecordBatch], model: dict, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, scores in _with_scores(batches, model):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
            names=["doc_id", "score", "predicted"])


def _passed(batches: Iterator[pa.RecordBatch], model: dict, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, scores in _with_scores(batches, model):
        yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every whole text; a null or empty text gets the bias.

    Null and repeated doc_ids are kept, one row for each input row; other columns are
    not read.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
            .mapInArrow(lambda b: _scored(b, model, threshold), "doc_id long, score double, predicted int"))


def drop_predicted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text scores under ``threshold``, whatever their ids."""
    return docs.mapInArrow(lambda b: _passed(b, model, threshold), docs.schema)
