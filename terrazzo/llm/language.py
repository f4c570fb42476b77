"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on byte segments of a bounded
sample, applied to every byte of every text: each position gets a distribution
over the languages and a document the mean over its positions. Texts are cut into
segments of ``SEGMENT`` bytes, so that a text of any length runs in wide batches
with bounded memory; the state starts at zero in each segment, in both directions.

Gates use x / (1 + |x|) in place of tanh (and half of it plus a half in place of
the logistic function): the same shape, a third of the cost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from .common import bounded_sample, held_out, keyed, ready, slices, utf8

#: Bytes of a segment, units of a direction, segments that run side by side.
SEGMENT, UNITS, WIDTH = 64, 8, 4096
#: Documents per language in the training sample; of a longer text, random segments are drawn.
PER_LANGUAGE, SEGMENTS_PER_TEXT = 400, 12
STEPS, BATCH, RATE = 260, 192, 0.012


def _soft(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place."""
    np.abs(x, out=room)
    room += 1
    x /= room


class Network:
    """Parameters: by direction the byte tables and the recurrent matrices of update, reset and candidate; the output layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        draw = np.random.default_rng(seed)
        h, c = UNITS, len(languages)
        self.languages = languages
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            for gate in "zrc":
                self.p[f"{d}E{gate}"] = (0.3 * draw.normal(size=(256, h))).astype(np.float32)
                self.p[f"{d}U{gate}"] = (0.4 * draw.normal(size=(h, h))).astype(np.float32)
            self.p[f"{d}V"] = (0.3 * draw.normal(size=(h, c))).astype(np.float32)
            for gate in "zr":
                self.p[f"{d}E{gate}"] -= np.float32(0.5 if gate == "z" else -0.5)
        self.p["bias"] = np.zeros(c, np.float32)

    def states(self, d: str, bytes_: np.ndarray, keep: bool = False):
        """Hidden states (time, segment, unit) of one direction; with ``keep`` also what the gradient needs."""
        p, (steps, n) = self.p, bytes_.shape
        one, half = np.float32(1), np.float32(0.5)
        out = np.empty((steps, n, UNITS), np.float32)
        h = np.zeros((n, UNITS), np.float32)
        room, x = np.empty_like(h), np.empty_like(h)
        tape = []
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        z, r, c, q = (np.empty_like(h) for _ in range(4))
        for t in order:
            if keep:
                z, r, c, q = (np.empty_like(h) for _ in range(4))
            i = bytes_[t]
            for g, gate in ((z, "z"), (r, "r")):
                np.matmul(h, p[f"{d}U{gate}"], out=g)
                np.take(p[f"{d}E{gate}"], i, axis=0, out=x, mode="clip")
                g += x
                _soft(g, room)
                g += one
                g *= half
            np.multiply(r, h, out=q)
            np.matmul(q, p[f"{d}Uc"], out=c)
            np.take(p[f"{d}Ec"], i, axis=0, out=x, mode="clip")
            c += x
            _soft(c, room)
            new = out[t]
            np.subtract(c, h, out=new)
            new *= z
            new += h
            if keep:
                tape.append((t, h, z, r, c, q))
            h = new
        return (out, tape) if keep else out

    def positions(self, bytes_: np.ndarray) -> np.ndarray:
        """Probabilities (time, segment, language)."""
        logits = self.states("f", bytes_) @ self.p["fV"]
        logits += self.states("b", bytes_) @ self.p["bV"]
        logits += self.p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradient(self, bytes_: np.ndarray, label: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the live positions and its gradient, by backpropagation through time."""
        p, (steps, n) = self.p, bytes_.shape
        runs = {d: self.states(d, bytes_, keep=True) for d in "fb"}
        logits = runs["f"][0] @ p["fV"] + runs["b"][0] @ p["bV"] + p["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        weight = live / max(1, live.sum())
        loss = float(-(np.log(prob[:, np.arange(n), label] + 1e-9) * weight).sum())
        prob[:, np.arange(n), label] -= 1
        prob *= weight[:, :, None].astype(np.float32)
        out = {"bias": prob.sum(axis=(0, 1))}
        for d in "fb":
            hidden, tape = runs[d]
            out[f"{d}V"] = hidden.reshape(-1, UNITS).T @ prob.reshape(-1, prob.shape[2])
            above = prob @ p[f"{d}V"].T
            inner = {g: np.empty((steps, n, UNITS), np.float32) for g in "zrc"}
            for g in "zrc":
                out[f"{d}U{g}"] = np.zeros((UNITS, UNITS), np.float32)
            back = np.zeros((n, UNITS), np.float32)
            for t, h, z, r, c, q in reversed(tape):
                back += above[t]
                dc = back * z * (1 - np.abs(c)) ** 2
                dz = back * (c - h) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dq = dc @ p[f"{d}Uc"].T
                dr = dq * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                out[f"{d}Uc"] += q.T @ dc
                out[f"{d}Uz"] += h.T @ dz
                out[f"{d}Ur"] += h.T @ dr
                back = back * (1 - z) + dq * r + dz @ p[f"{d}Uz"].T + dr @ p[f"{d}Ur"].T
                inner["c"][t], inner["z"][t], inner["r"][t] = dc, dz, dr
            flat = bytes_.reshape(-1)
            for g in "zrc":
                rows = inner[g].reshape(-1, UNITS)
                out[f"{d}E{g}"] = np.stack([np.bincount(flat, rows[:, u], 256) for u in range(UNITS)], axis=1).astype(np.float32)
        return loss, out


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 7) -> Network | None:
    """Adam over random segments, each language equally often. None if there is nothing to learn from."""
    rows = [(t, y) for t, y in zip(texts, labels, strict=True) if t and y is not None]
    if not rows:
        return None
    languages = sorted({y for _, y in rows})
    draw = np.random.default_rng(seed)
    by: list[list[bytes]] = [[] for _ in languages]
    for text, y in rows:
        last = max(0, len(text) - SEGMENT)
        starts = draw.integers(0, last + 1, size=min(SEGMENTS_PER_TEXT, 1 + last // SEGMENT))
        by[languages.index(y)] += [text[s : s + SEGMENT] for s in starts]
    net = Network(languages, seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        label = np.arange(BATCH) % len(languages)
        chosen = [by[y][draw.integers(len(by[y]))] for y in label]
        bytes_ = np.frombuffer(b"".join(c.ljust(SEGMENT, b"\0") for c in chosen), np.uint8).reshape(BATCH, SEGMENT).T.astype(np.intp)
        live = np.arange(SEGMENT)[:, None] < np.array([len(c) for c in chosen])
        _, slope = net.gradient(bytes_, label, live)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in slope.values())))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        rate = RATE * min(1.0, 1.5 * (1 - step / (steps + 1)))
        for k, g in slope.items():
            g = g * scale
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            net.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def document_probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over all byte positions of each row (rows without bytes: zeros)."""
    sizes = np.diff(offsets)
    per_row = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(sizes)), per_row)
    first = np.repeat(np.cumsum(per_row) - per_row, per_row)
    starts = np.repeat(offsets[:-1], per_row) + SEGMENT * (np.arange(len(owner)) - first)
    ends = np.minimum(starts + SEGMENT, np.repeat(offsets[1:], per_row))
    total = np.zeros((len(sizes), len(net.languages)))
    padded = np.concatenate([data, np.zeros(SEGMENT, np.uint8)])
    span = np.arange(SEGMENT)[:, None]
    for k in range(0, len(owner), WIDTH):
        s, e = starts[k : k + WIDTH], ends[k : k + WIDTH]
        bytes_ = padded[s + span]
        live = s + span < e
        bytes_[~live] = 0
        prob = net.positions(bytes_.astype(np.intp))
        prob *= live[:, :, None]
        pooled = prob.sum(axis=0)
        for y in range(len(net.languages)):
            total[:, y] += np.bincount(owner[k : k + WIDTH], pooled[:, y], len(sizes))
    return total / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """Text and lang of a bounded sample outside the held-out fold, gathered on the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = bounded_sample(rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()), per_language, "lang")
    got = rows.select("doc_id", F.col("text").cast("binary").alias("text"), "lang").toArrow().sort_by("doc_id")
    return got.column("text").to_pylist(), got.column("lang").to_pylist()


def identify(docs: DataFrame, net: Network | None = None, whole: bool = False) -> DataFrame:
    """Predict the language of each whole text: doc_id, held_out, lang_pred, score.

    ``net`` is trained on ``docs`` where none is given. A text that is null or has
    no letter is ``und`` with score 0, as is every text where no label could be
    learned from. The work is row by row, without a shuffle; repeated rows are each
    returned, and an empty table gives no rows. With ``whole`` a struct column ``row``
    has all columns of ``docs``.
    """
    spark = docs.sparkSession
    ready(spark)
    if net is None:
        net = train(*training_sample(docs))
    sent = spark.sparkContext.broadcast(net)  # some 14,000 numbers, whatever the input

    def run(batches):
        own = sent.value
        for part in slices(batches, 1 << 20):
            letters = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if own is None:
                pred, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            else:
                prob = document_probabilities(own, *utf8(part.column(1)))
                best = prob.argmax(axis=1)
                pred = np.where(letters, np.array([*own.languages], object)[best], "und")
                score = np.where(letters, np.clip(prob.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(pred, pa.string()), pa.array(score, pa.float64()), *part.columns[4:]], ["doc_id", "held_out", "lang_pred", "score", *part.schema.names[4:]])

    schema = StructType([StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    rows = keyed(docs, doc_id=doc_id, text=text, letters=F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), held_out=held_out(doc_id))
    if whole:
        schema = schema.add("row", docs.schema)
    return rows.select("doc_id", "text", "letters", "held_out", *(["row"] if whole else [])).mapInArrow(run, schema)


def keep_known(docs: DataFrame, languages: list[str] | None = None, least_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` in one of ``languages`` (None: all that are learned), all columns as they are.

    Texts without a letter go, and those whose language the network gives less than
    ``least_score``. Where ``docs`` has no label to learn from, only the letters
    decide. Null and empty texts go; repeated rows are each judged; an empty table
    gives no rows.
    """
    net = train(*training_sample(docs))
    if net is None:
        return docs.where(docs["text"].cast("string").rlike(r"\p{L}"))
    found = identify(docs, net, whole=True)
    known = F.col("lang_pred").isin(list(net.languages if languages is None else languages))
    return found.where(known & (F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")
