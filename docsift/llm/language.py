"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is lower-cased and cut into byte n-grams within words (a space marks a word's ends).
Each n-gram is hashed to an embedding; their average goes through a linear softmax.  The
model is trained by stochastic gradient descent in numpy, in one task, on a bounded sample
of labelled rows; a part of it, held back, fixes the temperature that calibrates the
probabilities and the score under which a prediction is rejected.  To predict, embeddings
and softmax weights are multiplied out beforehand (both are linear), so that a text costs
one small row for each n-gram.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_sample, one_text

BITS, DIM, ORDERS = 15, 16, (3, 4)
#: Training documents of each language and of all languages at most (about), passes over them, learning rate.
PER_LANGUAGE, ALL_LANGUAGES, EPOCHS, RATE = 600, 20_000, 4, 2.0
#: Share of right predictions on the held-back part whose scores fall under the rejection score, which is
#: never above EVEN (a language that is likelier than all others together is not rejected).
REJECTED, EVEN = 0.001, 0.5
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 20

_SPACE = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def _buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text, chunk by chunk (chunks overlap by an n-gram)."""
    data = b" " + text.lower().encode().translate(_SPACE) + b" "
    longest = max(ORDERS)
    for start in range(0, len(data), CHUNK):
        b = np.frombuffer(data, np.uint8, count=min(CHUNK + longest - 1, len(data) - start), offset=start)
        w = b.astype(np.uint32)
        space = b == 0x20
        for n in ORDERS:
            k = min(CHUNK, len(b) - n + 1)
            if k <= 0:
                continue
            g = np.full(k, n, np.uint32)
            inner = np.zeros(k, bool)
            for i in range(n):
                g = g * np.uint32(0x01000193) ^ w[i:i + k]
                if 0 < i < n - 1:
                    inner |= space[i:i + k]
            g = (g[~inner] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            yield g


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        idx, cnt = [], []
        for text in batch.column(2):
            total = np.zeros(1 << BITS, np.int64)
            for g in _buckets(text.as_py() or ""):
                total += np.bincount(g, minlength=1 << BITS)
            at = np.flatnonzero(total)
            idx.append(at.astype(np.int32))
            cnt.append(total[at])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(idx, pa.list_(pa.int32())), pa.array(cnt, pa.list_(pa.int64()))],
            names=["lang", "draw", "idx", "cnt"])


def fit(rows: pd.DataFrame) -> dict:
    """Train on rows of lang, draw, idx, cnt; the model as arrays."""
    rows = rows[rows["idx"].map(len) > 0].sort_values("draw", kind="stable").reset_index(drop=True)
    langs = sorted(rows["lang"].unique())
    if not langs:
        return {"langs": [], "table": None, "temperature": 1.0, "reject": 0.0}
    y = rows["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy()
    held = np.arange(len(rows)) % 5 == 4
    rng = np.random.default_rng(7)
    emb = rng.uniform(-1, 1, (1 << BITS, DIM)) / DIM
    out, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    idx = [np.asarray(i) for i in rows["idx"]]
    weight = [np.asarray(c) / np.sum(c) for c in rows["cnt"]]
    train = np.flatnonzero(~held)
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for d in rng.permutation(train):
            rate = RATE * (1 - step / steps)
            step += 1
            h = weight[d] @ emb[idx[d]]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= rate * 0.1 * p
            emb[idx[d]] -= rate * np.outer(weight[d], back)
    table = emb @ out + bias
    check = np.flatnonzero(held) if held.any() else train
    z = np.array([weight[d] @ table[idx[d]] for d in check])

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) * t)
        return e / e.sum(axis=1, keepdims=True)

    loss = {t: -np.log(probabilities(t)[np.arange(len(check)), y[check]] + 1e-12).mean()
            for t in np.geomspace(0.25, 16, 25)}
    t = min(loss, key=loss.get)
    p = probabilities(t)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    return {"langs": langs, "table": table.astype(np.float32), "temperature": float(t),
            "reject": min(EVEN, float(np.quantile(right, REJECTED))) if len(right) else 0.0}


def train(labelled: DataFrame) -> dict:
    """The model for rows of doc_id, text, lang.  Rows without a lang don't count; without
    any labelled text the model knows no language and every prediction is ``und``."""
    rows = labelled.select("doc_id", "lang", "text").where(F.col("lang").isNotNull())
    sample = (bounded_sample(rows.select("doc_id", "lang"), "lang", PER_LANGUAGE, ALL_LANGUAGES)
              .select(F.col("doc_id").alias("s_id"), F.col("lang").alias("s_lang"), "draw").distinct())
    # the sample's size is bounded: its ids go to the texts
    drawn = rows.join(F.broadcast(sample), (F.col("doc_id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang")))
    drawn = one_text(drawn.select("s_id", "lang", "draw", "text"), ["s_id", "lang", "draw"])
    features = drawn.select("lang", "draw", "text").mapInArrow(
        _features, "lang string, draw long, idx array<int>, cnt array<long>")
    model = (features.groupBy().applyInPandas(
        lambda rows: pd.DataFrame({"model": [pickle.dumps(fit(rows))]}), "model binary")).collect()
    return pickle.loads(model[0].model) if model else fit(pd.DataFrame({"lang": [], "draw": [], "idx": [], "cnt": []}))


def _with_languages(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
    """Each batch with its texts' languages, scores and whether they are rejected."""
    langs, table, temperature = model["langs"], model["table"], model["temperature"]
    for batch in batches:
        found, scores = [], []
        for value in batch.column(batch.schema.get_field_index("text")):
            text = value.as_py() or ""
            lang, score = "und", 0.0
            if langs and _LETTER.search(text):
                total, n = np.zeros(len(langs)), 0
                for g in _buckets(text):
                    total += np.take(table, g, axis=0).sum(axis=0)
                    n += len(g)
                z = total / max(n, 1) * temperature
                p = np.exp(z - z.max())
                p /= p.sum()
                lang, score = langs[int(p.argmax())], float(p.max())
            found.append(lang)
            scores.append(score)
        yield batch, found, scores, [x == "und" or s < model["reject"] for x, s in zip(found, scores)]


def _predicted(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for batch, found, scores, rejected in _with_languages(batches, model):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["doc_id", "lang_pred", "score", "rejected"])


def _passed(batches: Iterator[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    for batch, _, _, rejected in _with_languages(batches, model):
        yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every whole text.

    A null text or one without a letter is ``und`` with score 0, and rejected.  Null and
    repeated doc_ids are kept, one row for each input row; other columns are not read.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
            .mapInArrow(lambda b: _predicted(b, model),
                        "doc_id long, lang_pred string, score double, rejected boolean"))


def drop_rejected(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text isn't rejected, whatever their ids."""
    return docs.mapInArrow(lambda b: _passed(b, model), docs.schema)
