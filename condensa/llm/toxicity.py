"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the hashes of its lower-cased words and of their first bytes (so
that a stem counts whatever its ending), of two and of three neighbours, and of two words
with one between them, each present or absent. The
learner (McMahan et al., 2013) keeps a rate for each coordinate and an L1 term that
holds most weights at exactly zero, so that what is broadcast is a few thousand
(bucket, weight) pairs whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import spread
from ._arrow import mix, row_of, word_slices
from ._shared import release, small_batches

#: At most so many rows are used to fit: one of each of the labelled ids with the least hashes.
MAX_TRAIN_ROWS = 12_000
BITS = 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 1.0
STEMS = (4, 5, 6)
THRESHOLD = 0.3

_SALTS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]


@dataclass(frozen=True)
class Model:
    """Sparse weights: bucket numbers in ascending order and their weights."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.buckets] = self.weights
        return out


def _features(h: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """(buckets, words they span) for each kind of feature, by the position of the first word."""
    shift = np.uint64(64 - bits)
    for k in range(1, h.shape[1]):
        yield (mix(h[:, k] ^ _SALTS[2] + np.uint64(k)) >> shift).astype(np.int64), 1
    h = h[:, 0]
    salt = np.uint64(0x9FB21C651E98DF25)
    yield (mix(h ^ _SALTS[0]) >> shift).astype(np.int64), 1
    two = mix(h[:-1] * salt + h[1:]) if len(h) > 1 else h[:0]
    yield (mix(two ^ _SALTS[1]) >> shift).astype(np.int64), 2
    if len(h) > 2:
        yield (mix(two[:-1] * salt + h[2:]) >> shift).astype(np.int64), 3
        yield (mix((h[:-2] * salt + h[2:]) ^ _SALTS[3]) >> shift).astype(np.int64), 3


def _doc_features(h: np.ndarray, bits: int) -> np.ndarray:
    return np.unique(np.concatenate([f for f, _ in _features(h, bits)])) if len(h) else np.zeros(0, np.int64)


def fit(rows: list[tuple[np.ndarray, int]], *, bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """FTRL-proximal over (buckets, label) in the given order. The bias isn't held back by L1."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weights(i: np.ndarray) -> np.ndarray:
        zi, held = z[i], np.where(i == bias, 0.0, l1)
        return np.where(np.abs(zi) <= held, 0.0, -(zi - np.sign(zi) * held) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for buckets, label in rows:
            i = np.append(buckets, bias).astype(np.int64)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / alpha * w
            n[i] = more
    w = weights(np.arange(bias + 1))
    kept = np.flatnonzero(w[:bias])
    return Model(kept, w[kept].astype(np.float32), float(w[bias]), bits)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_TRAIN_ROWS, bits: int = BITS) -> Model:
    """Fit on at most max_rows labelled rows, spread over all ids by a hash.

    Rows without an id, a text or a label don't count. A label given twice for an id counts
    once, the larger; an id with several texts counts once, with that of the least hash. Texts
    count whole. With no labelled row, or only one class, the model accepts every text.
    """
    picked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__y"))
    picked = picked.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)  # broadcast: max_rows rows of two numbers
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(picked), "__id")
    # Partial aggregates: however often an id comes, a task passes one of its texts on.
    rows = rows.groupBy("__id", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), F.col("__text").alias("text"))).alias("__one"))
    rows = rows.select(F.xxhash64("__id").alias("place"), F.col("__id").cast("string").alias("id"), F.col("__y").alias("y"), F.col("__one.text").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, h, _, _, bounds, _, _ in word_slices(batch.column("text"), prefixes=STEMS):
                out += [_doc_features(h[a:b], bits).astype(np.int32).tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("place", "id", "y")), pa.array(out, pa.binary())], ["place", "id", "y", "f"])
        release()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(*row, f) for b in batches for *row, f in zip(*(b.column(c).to_pylist() for c in ("place", "id", "y")), b.column("f"))]
        if len({y for _, _, y, _ in rows}) < 2:
            return
        rows.sort(key=lambda r: r[:2])  # whatever the way they came
        m = fit([(np.frombuffer(f.as_buffer(), np.int32), y) for _, _, y, f in rows], bits=bits)  # the features stay where Arrow put them
        del rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(m.buckets, -1), pa.int64()), pa.array(np.append(m.weights, np.float32(m.bias)), pa.float32())], ["bucket", "weight"])
        release()

    one = small_batches(rows).mapInArrow(featurise, "place long, id string, y int, f binary").repartition(1)
    found = one.mapInArrow(learn, "bucket long, weight float").toArrow()  # at most 2**bits + 1 pairs
    b, w = found.column("bucket").to_numpy(), found.column("weight").to_numpy()
    if not len(b):
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), -35.0, bits)
    return Model(b[:-1], w[:-1], float(w[-1]), bits)


def _scores(texts: pa.Array, model: Model, dense: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(probability, whether it counts as toxic). The bias alone, however common toxic rows were, is no evidence."""
    out = np.zeros(len(texts))
    for lo, hi, h, _, _, bounds, _, _ in word_slices(texts, prefixes=STEMS):
        if not len(h):
            continue
        row, found = row_of(bounds), []
        for buckets, span in _features(h, model.bits):
            at = np.flatnonzero(dense[buckets])
            at = at[row[at] == row[at + span - 1]]
            found.append(np.stack([row[at], buckets[at]], 1))
        found = np.concatenate(found)
        if len(found):  # each feature counts once for a text
            key = np.unique((found[:, 0] << model.bits) | found[:, 1])
            out[lo:hi] += np.bincount(key >> model.bits, dense[key & ((1 << model.bits) - 1)], hi - lo)
    p = 1 / (1 + np.exp(-np.clip(out + model.bias, -35, 35)))
    return p, (p >= threshold) & (out > 0)


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity, toxic) for every row, in one narrow pass.

    A null or empty text has the score of the bias alone and isn't toxic; rows repeat as they do in docs; an
    id that is null stays null. A text counts whole, in pieces if it is long; a score that equals the threshold is
    toxic. An empty table gives no rows. Other columns don't matter, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        dense = m.dense()
        for batch in batches:
            p, toxic = _scores(batch.column("__text"), m, dense, threshold)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(np.round(p, 6)), pa.array(toxic)], ["doc_id", "toxicity", "toxic"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return small_batches(docs).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, f"doc_id {kind}, toxicity double, toxic boolean")


def reject(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text isn't toxic, with all their columns. Null and empty texts stay, and repeated rows as
    often as they come. Long texts, ties and an empty table are as in score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def toxic(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        dense = m.dense()
        for texts in parts:
            yield pa.array(_scores(texts, m, dense, threshold)[1])

    return small_batches(docs).where(~toxic(F.col(text)))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
