"""Quality by ordinal cumulative-link regression on graded ratings.

One vector of hashed-text weights is shared by all grades; ordered thresholds cut
its score into grades: P(grade <= k) = logistic(threshold_k - score). The result gives
the expected grade and the probability of the top grades, by which texts are selected.
Features are the relative frequencies of hashed byte trigrams, and how large a share
of the words repeats the word before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, held_out, ready, slices, utf8, word_hashes, words
from .toxicity import labelled_texts, lower

#: Hashed features, rated texts per grade in the sample, steps and rate of training, L2 strength.
FEATURES, PER_GRADE, STEPS, RATE, L2 = 1 << 14, 1500, 150, 0.3, 1e-4
#: Relative frequencies are small; this brings them near one.
SCALE = 30.0


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number of the three bytes from each place on, and how many places each row has."""
    sizes = np.maximum(np.diff(offsets) - 2, 0)
    if len(data) < 3:
        return np.zeros(0, np.int64), sizes
    low = lower(data).astype(np.uint32)
    code = low[:-2] * np.uint32(0x10001) + low[1:-1] * np.uint32(0x9E35) + low[2:] * np.uint32(0x6F4F27)
    code = (code ^ (code >> np.uint32(13))) * np.uint32(0x85EBCA6B)
    number = ((code >> np.uint32(9)) % np.uint32(FEATURES)).astype(np.int64)
    inside = np.ones(len(data), bool)
    ends = offsets[1:][np.diff(offsets) > 0]
    inside[ends - 1] = False
    inside[np.maximum(ends - 2, 0)] = False
    return number[inside[: len(number)]], sizes


def repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of the words of each row that are the same as the word before."""
    starts, ends, per_row = words(data, offsets)
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(per_row)), per_row)
    again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][again], minlength=len(per_row)) / np.maximum(per_row, 1)


class Ordinal:
    def __init__(self, grades: list[int], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def at_most(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for all grades but the last: (rows, grades - 1)."""
        return 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -35, 35)))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        number, sizes = trigrams(data, offsets)
        again = SCALE * self.weights[FEATURES] * repeats(data, offsets)
        total = np.concatenate([[0.0], np.cumsum(self.weights[number])])
        ends = np.cumsum(sizes)
        return SCALE * (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1) + again


def train(texts: list[bytes], grades: list[int]) -> Ordinal:
    """Full-batch Adam on the likelihood, each grade weighing the same; thresholds are kept in order by positive gaps."""
    kinds = sorted(set(grades))
    if len(kinds) < 2:
        return Ordinal(kinds or [0], np.zeros(FEATURES + 1), np.zeros(0))
    numbers, rows, values = [], [], []
    for k in range(0, len(texts), 256):
        own = texts[k : k + 256]
        data, offsets = np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in own])])
        number, sizes = trigrams(data, offsets)
        key, n = np.unique(np.repeat(np.arange(len(own)), sizes) * FEATURES + number, return_counts=True)
        r = key // FEATURES
        numbers += [(key % FEATURES).astype(np.int32), np.full(len(own), FEATURES, np.int32)]
        rows += [(r + k).astype(np.int32), np.arange(k, k + len(own), dtype=np.int32)]
        values += [(SCALE * n / np.maximum(sizes[r], 1)).astype(np.float32), (SCALE * repeats(data, offsets)).astype(np.float32)]
    number, row, value = np.concatenate(numbers), np.concatenate(rows), np.concatenate(values)
    y = np.searchsorted(kinds, grades)
    weigh = (1 / np.bincount(y))[y] / len(kinds)
    m = len(kinds) - 1
    p = {"w": np.zeros(FEATURES + 1), "first": np.array([-0.5 * m]), "gap": np.zeros(m - 1)}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))

    def cumulative(t, s):
        return 1 / (1 + np.exp(-np.clip(t - s, -35, 35)))

    for step in range(1, STEPS + 1):
        gap = np.logaddexp(0, p["gap"])
        cuts = np.concatenate([p["first"], p["first"] + np.cumsum(gap)])
        score = np.bincount(row, p["w"][number] * value, len(y))
        upper = np.where(y < m, cumulative(cuts[np.minimum(y, m - 1)], score), 1.0)
        below = np.where(y > 0, cumulative(cuts[np.maximum(y - 1, 0)], score), 0.0)
        likely = np.maximum(upper - below, 1e-12)
        du, db = upper * (1 - upper) / likely * weigh, below * (1 - below) / likely * weigh
        g_score = du - db  # of the negative log-likelihood
        g_cut = np.zeros(m)
        np.add.at(g_cut, np.minimum(y, m - 1), np.where(y < m, -du, 0))
        np.add.at(g_cut, np.maximum(y - 1, 0), np.where(y > 0, db, 0))
        tail = np.cumsum(g_cut[::-1])[::-1]
        slope = {
            "w": np.bincount(number, g_score[row] * value, FEATURES + 1) + L2 * p["w"],
            "first": tail[:1],
            "gap": tail[1:] / (1 + np.exp(-p["gap"])),
        }
        for k, g in slope.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            p[k] = p[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    gap = np.logaddexp(0, p["gap"])
    return Ordinal(kinds, p["w"], np.concatenate([p["first"], p["first"] + np.cumsum(gap)]))


def grades_of(labels: DataFrame) -> DataFrame:
    """A rating from the two labels: 0 poor, 1 good but toxic, 2 good (doc_id, grade)."""
    good, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labels.select("doc_id", F.when(good == 0, 0).when(good > 0, F.when(toxic > 0, 1).otherwise(2)).alias("grade"))


def rate_quality(docs: DataFrame, ratings: DataFrame, at_least: int | None = None, model: Ordinal | None = None) -> DataFrame:
    """Rate each whole text: doc_id, held_out, expected_grade, tail_prob, selected.

    ``ratings`` (doc_id, grade) may have any number of ordered whole-number grades;
    tail_prob is the probability of ``at_least`` (by default the second lowest grade)
    or better, and a text is selected if that is 0.5 or more. Null and empty texts
    are scored as texts without features but never selected; with fewer than two
    grades nothing can be learned and every rated text is selected. Rows are rated
    one by one without a shuffle; repeated rows are each returned; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    if model is None:
        got = labelled_texts(docs, ratings, "grade", PER_GRADE)[0].toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
        model = train(got.column("text").to_pylist(), got.column("label").to_pylist())
    if at_least is None:
        at_least = model.grades[min(1, len(model.grades) - 1)]
    sent = spark.sparkContext.broadcast(model)  # FEATURES numbers, whatever the input

    def run(batches):
        own = sent.value
        steps = np.diff(own.grades)
        below = sum(g < at_least for g in own.grades)
        for part in slices(batches, 1 << 20):
            data, offsets = utf8(part.column(1))
            above = 1 - own.at_most(own.scores(data, offsets))
            expected = own.grades[0] + above @ steps
            tail = above[:, below - 1] if 0 < below <= len(steps) else np.full(part.num_rows, float(below == 0))
            chosen = (tail >= 0.5) & (np.diff(offsets) > 0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(expected), pa.array(tail), pa.array(chosen)], ["doc_id", "held_out", "expected_grade", "tail_prob", "selected"])

    return documents_of(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, expected_grade double, tail_prob double, selected boolean")
