"""Toxicity scores by FTRL-proximal logistic regression on hashed words, pairs and skip-pairs.

Learned on a bounded labelled sample with per-coordinate rates and L1 sparsity; the
few weights that are not zero go to the workers, which score every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _P, bounded_sample, documents_of, held_out, mix, ready, slices, utf8, word_hashes, words

#: Number of hashed features; labelled texts per class in the sample; passes over it.
FEATURES, PER_CLASS, PASSES = 1 << 18, 2500, 6
#: FTRL-proximal: rate, smoothing, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 0.5
#: Lengths in bytes of the word beginnings that count as words too: they carry over to other endings.
BEGINNINGS = (5, 7)
#: A feature counts at most this often in one text.
MOST = 3


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every word and its beginnings, every pair of neighbours and every pair with one word between."""
    starts, ends, per_row = words(data, offsets)
    low = lower(data)
    h = word_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(per_row)), per_row)
    rows, found = [row], [h]
    for n in BEGINNINGS:
        longer = ends - starts > n
        rows.append(row[longer])
        found.append(mix(word_hashes(low, starts[longer], starts[longer] + n) + np.uint64(n)))
    for gap, salt in ((1, 0x51ED270B), (2, 0x7F4A7C15)):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            found.append(mix(h[:-gap][same] * _P + h[gap:][same] + np.uint64(salt)))
    return np.concatenate(rows), (np.concatenate(found) % np.uint64(FEATURES)).astype(np.int64)


class Weights:
    """The sparse result of training: numbers and weights of the features that count, and a bias."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray, bias: float):
        self.numbers, self.values, self.bias = numbers, values, bias

    def dense(self) -> np.ndarray:
        out = np.zeros(FEATURES)
        out[self.numbers] = self.values
        return out


def counts(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row the distinct features and how often they count."""
    row, found = features(data, offsets)
    key, n = np.unique(row * FEATURES + found, return_counts=True)
    cuts = np.searchsorted(key, np.arange(len(offsets)) * FEATURES)
    return [(key[a:b] % FEATURES, np.minimum(n[a:b], MOST).astype(float)) for a, b in zip(cuts[:-1], cuts[1:])]


def train(texts: list[bytes], labels: list[int], prior: float | None = None, seed: int = 3) -> Weights:
    """FTRL-proximal, one text at a time; ``prior`` is the share of label 1 where the scores will be used."""
    n, z = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    w = np.zeros(FEATURES + 1)
    if not texts:
        return Weights(np.zeros(0, np.int64), np.zeros(0), 0.0)
    rows = []
    for k in range(0, len(texts), 256):
        part = texts[k : k + 256]
        rows += counts(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in part])]))
    y = np.array(labels, float)
    share = y.mean()
    draw = np.random.default_rng(seed)
    for _ in range(PASSES):
        for k in draw.permutation(len(rows)):
            at, x = rows[k]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            nn, zz = n[at], z[at]
            strength = np.where(at == FEATURES, 0.0, L1)
            own = np.where(np.abs(zz) > strength, (np.sign(zz) * strength - zz) / ((BETA + np.sqrt(nn)) / ALPHA + L2), 0.0)
            p = 1 / (1 + np.exp(-np.clip(own @ x, -35, 35)))
            g = (p - y[k]) * x
            step = (np.sqrt(nn + g * g) - np.sqrt(nn)) / ALPHA
            z[at] = zz + g - step * own
            n[at] = nn + g * g
    strength = np.full(FEATURES + 1, L1)
    strength[-1] = 0
    live = np.abs(z) > strength
    w[live] = ((np.sign(z) * strength - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))[live]
    bias = float(w[-1])
    if prior is not None and 0 < prior < 1 and 0 < share < 1:
        bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    numbers = np.flatnonzero(w[:-1])
    return Weights(numbers, w[numbers], bias)


def scores(own: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row."""
    row, found = features(data, offsets)
    live = own[found] != 0
    row, found = row[live], found[live]
    # Only the few features with a weight are counted, each MOST times at most.
    key, n = np.unique(row * FEATURES + found, return_counts=True)
    total = np.bincount(key // FEATURES, own[key % FEATURES] * np.minimum(n, MOST), len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(total + bias, -35, 35)))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts of a bounded sample of the rows of ``labels`` outside the held-out fold, and how many rows each class has."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = bounded_sample(known, per_class, "label")  # per_class rows a class: small enough to send everywhere
    return documents_of(docs).join(F.broadcast(sample), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "label"), sizes


def learn(docs: DataFrame, labels: DataFrame) -> Weights:
    rows, sizes = labelled_texts(docs, labels.withColumn("toxic", (F.col("toxic").cast("int") > 0).cast("int")), "toxic", PER_CLASS)
    got = rows.toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    return train(got.column("text").to_pylist(), got.column("label").to_pylist(), sizes.get(1, 0) / max(1, sum(sizes.values())))


def score_toxicity(docs: DataFrame, labels: DataFrame, weights: Weights | None = None) -> DataFrame:
    """Score each whole text: doc_id, held_out, score, predicted.

    Without ``weights`` they are learned from ``labels`` (doc_id, toxic). Null and
    empty texts get the score of a text without words; without labels every score
    is 0.5. Rows are scored one by one without a shuffle; repeated rows are each
    returned, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(weights if weights is not None else learn(docs, labels))

    def run(batches):
        own, bias = sent.value.dense(), sent.value.bias
        for part in slices(batches, 1 << 20):
            score = scores(own, bias, *utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return documents_of(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
