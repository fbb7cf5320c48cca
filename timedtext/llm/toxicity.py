"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct places, modulo 2**BITS, of its words, word beginnings (4 to 6 bytes, so that
endings matter less), word pairs, and pairs that skip one word. Each coordinate has its own learning rate, and the L1
term keeps most weights at exactly 0, so the model is a short list that is broadcast for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timedtext.llm.common import id_bucket, prepare, text_bytes
from timedtext.llm.words import ALNUM, Words, blocks, chained, mix, words_of

BITS = 22
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.1
EPOCHS = 3
#: The classifier is fitted on at most so many labelled rows, those with the least hashed ids.
SAMPLE = 8_000

_models: dict[int, tuple[np.ndarray, float]] = {}


def feature_places(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, place) arrays of each kind of feature of all texts in w."""
    kinds = [(w.row, w.hash)] + [(w.row, w.prefixes(n)) for n in (4, 5, 6)]
    for gap in (1, 2):
        ends = w.row[:-gap] == w.row[gap:]
        pair = chained(w.hash, 2) if gap == 1 else mix(w.hash[:-gap] * np.uint64(0x9E3779B97F4A7C15) + mix(w.hash[gap:]))
        kinds.append((w.row[:-gap][ends], pair[: len(ends)][ends]))
    return [(r, ((h + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int64)) for k, (r, h) in enumerate(kinds)]


def fit(texts: list[bytes], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Places and values of the weights that are not 0, and the bias."""
    per_text: list[np.ndarray] = []
    for a, b in blocks(texts):
        kinds = feature_places(words_of(texts[a:b], ALNUM))
        row, place = np.concatenate([r for r, _ in kinds]), np.concatenate([p for _, p in kinds])
        both = np.unique(row << BITS | place)
        cut = np.searchsorted(both, np.arange(1, b - a) << BITS)
        per_text += [x.astype(np.int32) for x in np.split(both & ((1 << BITS) - 1), cut)]
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    share = (sum(labels) + 0.5) / (len(labels) + 2)
    bias, bias_n = float(np.log(share / (1 - share))), 1.0
    for _ in range(epochs):
        for at, y in zip(per_text, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y
            was = n[at]
            n[at] = was + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(was)) / ALPHA * w
            bias_n += g * g
            bias -= 0.1 * g / np.sqrt(bias_n)
    w = weights(slice(None))
    at = np.flatnonzero(w)
    return at, w[at], bias


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((k, t, y) for b in batches for k, t, y in zip(b.column("key").to_pylist(), b.column("bytes").to_pylist(), b.column("toxic").to_pylist(), strict=True))
    at, w, bias = fit([t for _, t, _ in rows], [y for _, _, y in rows])
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(w, bias), pa.float64())], names=["place", "weight"])


def model_scores(texts: list[bytes], dense: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for a, b in blocks(texts):
        hit = []
        for row, place in feature_places(words_of(texts[a:b], ALNUM)):
            on = np.flatnonzero(dense[place])
            hit.append(row[on] << BITS | place[on])
        hits = np.unique(np.concatenate(hit))
        np.add.at(out, a + (hits >> BITS), dense[hits & ((1 << BITS) - 1)].astype(np.float64))
    return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = model.value
        if model.id not in _models:
            _models.clear()
            dense = np.zeros(1 << BITS, np.float32)
            dense[at] = w
            _models[model.id] = dense, bias
        for batch in batches:
            scores = model_scores(batch.column("bytes").to_pylist(), *_models[model.id])
            kept = [n for n in batch.schema.names if n != "bytes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(scores, pa.float64())], names=[*kept, "score"])

    return run


class _Model:
    """Broadcast weights with an id, so that a worker builds the dense table once."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learnt from labelled rows outside the held-out fifth. Null labels and ids are left out; of repeated
    label rows of one document the largest label counts, and of repeated documents the least text: a case per id."""
    learn = labels.filter("doc_id is not null and toxic is not null").filter(id_bucket(F.col("doc_id"), 5) != 0)
    learn = learn.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("key", F.xxhash64("doc_id"))
    learn = learn.orderBy("key", "doc_id").limit(sample)  # bounded by the parameter, so safe to broadcast
    cases = docs.select("doc_id", text_bytes("text").alias("bytes")).join(F.broadcast(learn), "doc_id")
    cases = cases.groupBy("doc_id").agg(F.first("key").alias("key"), F.min("bytes").alias("bytes"), F.first("toxic").cast("int").alias("toxic"))
    cases = cases.select("key", "bytes", "toxic")
    rows = cases.repartition(1).mapInArrow(_fitted, "place long, weight double").toPandas()
    bias = rows.loc[rows["place"] < 0, "weight"]
    rows = rows[rows["place"] >= 0]
    return rows["place"].to_numpy(), rows["weight"].to_numpy(), float(bias.iloc[0]) if len(bias) else -1.0


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with score (0 to 1) added, whatever its other columns are; a column named score is replaced.

    Null and empty texts get the bias alone. Without labelled rows every score is that of the clean prior.
    """
    spark = prepare(docs.sparkSession)
    model = train(docs, labels, sample)
    kept = [c for c in docs.columns if c not in ("score", "bytes")]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), text_bytes("text").alias("bytes"))
    schema = rows.select(*(f"`{c}`" for c in kept)).schema.add("score", "double")
    held = _Model(spark.sparkContext.broadcast(model), hash((len(model[0]), model[0].tobytes(), model[1].tobytes(), model[2])))
    return rows.mapInArrow(_scored(held), schema)
