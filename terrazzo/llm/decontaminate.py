"""Benchmark decontamination by latent semantic retrieval.

Passages of the corpus form a TF-IDF matrix over the words of the benchmark. Its right
singular vectors come from a distributed randomised decomposition: every task adds up
A'(A W) for a fixed random W over its own passages, the sum is turned into singular
vectors by the Nystroem formula on the driver, which only ever sees a matrix of fixed
size. Word counts and the decomposition cover every passage of the corpus.

An item is looked for among windows as long as itself. A window whose cosine with the
item in the latent space is COSINE or more is a candidate; it is compared word by
word: a document is contaminated when the longest common subsequence covers most of an
item, or a smaller part of it with the item's ending (its answer) in place. Vectors are
only made where a leak can be at all: of an item's rarest words (its anchors), so many
are taken that by the pigeonhole principle every stretch that the later comparison
accepts has a few of them. This bound rules out nothing that would be found. Items of up
to SHORT words, whose cosines say little, need no cosine. Everything is narrow except
the sums, whose size doesn't depend on the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import documents_of, keyed, mix, ready, slices, utf8, word_hashes, words
from .segments import ranges

#: Words of a passage; rank of the latent space and random directions drawn.
PASSAGE, RANK, DRAWN = 32, 96, 128
#: Passages whose vectors are held at once; rows that are added up side by side.
BLOCK, LANES = 4096, 16
#: Least cosine of a candidate with an item of more than SHORT words.
COSINE, SHORT = 0.5, 12
#: So many anchors of an item stand in every leak of it.
ANCHORS = 4
#: Share of an item's words, in order, that makes a leak: alone, or with as much of its ending.
ALONE, WITH_ANSWER = 0.75, 0.55
ANSWER_WORDS = 6
#: Items that are looked for together; their words fall into at most COLUMNS columns.
ITEMS, COLUMNS = 1024, 1 << 14
#: Items of fewer words say too little inside a longer text: they are found in texts that have no other words.
LEAST_WORDS = 5
PIECE = 256 << 10

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _FOLD[_c] = 0x20
_WORD = re.compile(r"[^\s!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+", re.ASCII)


def terms(data: np.ndarray, offsets: np.ndarray):
    """Begin and end of each word (ASCII signs count as spaces, A-Z as a-z), its hash, and words per row."""
    low = _FOLD[data]
    starts, ends, per_row = words(low, offsets)
    return starts, ends, word_hashes(low, starts, ends), per_row


def cut_words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def common_subsequence(item: list[str], text: list[str]) -> tuple[int, int]:
    """Length of the longest common subsequence of both, and of the item's last words with the text (bit-parallel)."""
    place: dict[str, int] = {}
    for k, w in enumerate(item):
        place[w] = place.get(w, 0) | (1 << k)
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        m = place.get(w, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    n = min(ANSWER_WORDS, len(item))
    tail_full, shift = (1 << n) - 1, len(item) - n
    t = tail_full
    for w in text:
        m = place.get(w, 0) >> shift
        if m:
            u = t & m
            t = ((t + u) | (t - u)) & tail_full
    return len(item) - v.bit_count(), n - t.bit_count()


def row_sums(rows: np.ndarray, index: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``rows[index]`` over neighbouring runs of ``sizes`` entries; the last of ``rows`` is zero.

    Runs are cut into groups of LANES whose rows are added lane by lane, and the groups' sums likewise
    until each run has one (numpy's reduceat takes ten times as long on short runs).
    """
    while True:
        groups = np.maximum(1, -(-sizes // LANES))
        lanes = np.full((int(groups.sum()), LANES), len(rows) - 1, np.int64)
        lanes.reshape(-1)[ranges((np.cumsum(groups) - groups) * LANES, sizes)] = index
        out = rows[lanes[:, 0]]
        room = np.empty_like(out)
        for j in range(1, LANES):
            np.take(rows, lanes[:, j], axis=0, out=room, mode="clip")
            out += room
        if len(out) == len(sizes):
            return out
        rows = np.concatenate([out, np.zeros((1, out.shape[1]), out.dtype)])
        index, sizes = np.arange(len(out)), groups


class Space:
    """Vocabulary, weights and latent space of a block of items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.words = [cut_words(t) for t in texts]
        self.short: dict[tuple[str, ...], list[int]] = {}
        for i, w in zip(ids, self.words):
            if 0 < len(w) < LEAST_WORDS:
                self.short.setdefault(tuple(w), []).append(i)
        keep = [k for k, w in enumerate(self.words) if len(w) >= LEAST_WORDS]
        self.ids, self.words, texts = [ids[k] for k in keep], [self.words[k] for k in keep], [texts[k] for k in keep]
        data, offsets = utf8(pa.array(texts, pa.string()))
        _, _, h, per_row = terms(data, offsets)
        self.vocabulary, column = np.unique(h, return_inverse=True)
        self.item_words = np.split(column, np.cumsum(per_row)[:-1]) if len(per_row) else []
        self.column = (np.arange(len(self.vocabulary)) if len(self.vocabulary) <= COLUMNS else mix(self.vocabulary) % np.uint64(COLUMNS)).astype(np.int64)
        self.size = int(min(COLUMNS, max(1, len(self.vocabulary))))
        self.item_terms = np.split(self.column[column], np.cumsum(per_row)[:-1]) if len(per_row) else []
        self.idf = np.ones(self.size)
        self.random = np.random.default_rng(11).normal(size=(self.size, DRAWN)).astype(np.float32)

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that the vocabulary has, and their places in it."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == h)
        return known, at[known]

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that the vocabulary has, and their columns."""
        known, at = self.known(h)
        return known, self.column[at]

    def weighted(self, matrix: np.ndarray) -> np.ndarray:
        """``matrix`` with the idf in it and a row of zeros below, for ``row_sums``: its sums over the columns of a passage are a row of A @ matrix."""
        return np.concatenate([self.idf[:, None] * matrix, np.zeros((1, matrix.shape[1]))]).astype(np.float32)

    def solve(self, total: np.ndarray) -> None:
        """Right singular vectors from sum = A'A W (Nystroem), and the items in their space."""
        shift = 1e-6 * max(1.0, np.linalg.norm(total))
        w = self.random.astype(float)
        y = total + shift * w
        core = w.T @ y
        root = np.linalg.cholesky((core + core.T) / 2 + 1e-9 * max(1.0, np.trace(core)) * np.eye(DRAWN))
        u, s, _ = np.linalg.svd(np.linalg.solve(root, y.T).T, full_matrices=False)
        self.singular = np.sqrt(np.maximum(s[:RANK] ** 2 - shift, 0))
        self.basis = u[:, :RANK]
        self.project = self.weighted(self.basis)
        items = np.array([self.project[own].sum(axis=0) for own in self.item_terms], np.float32).reshape(-1, self.basis.shape[1])
        self.items = items / np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
        self.anchor()
        del self.random

    def anchor(self) -> None:
        """Anchors of each item by word. A leak lacks n - least words of an item at most, so of that many and ``met`` more it has ``met``."""
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.span = np.array([span_of(len(w)) for w in self.words], np.int64)
        self.step = np.array([step_of(len(w)) for w in self.words], np.int64)
        self.met = np.zeros(len(self.words), np.int64)
        pairs = []
        for k, own in enumerate(self.item_words):
            n = len(own)
            least = next(c for c in range(n + 1) if c / n >= min(ALONE, WITH_ANSWER))
            self.met[k] = min(ANCHORS, least)
            rarest = np.argsort(-self.idf[self.column[own]], kind="stable")[: n - least + self.met[k]]
            pairs += [(w, k) for w in np.unique(own[rarest]).tolist()]
        word, self.anchored = (np.array(x, np.int64) for x in zip(*sorted(pairs))) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.n_anchored = np.bincount(word, minlength=len(self.vocabulary))
        self.first_anchored = np.cumsum(self.n_anchored) - self.n_anchored


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """Add up (part, packed numbers) rows by part, and lay the parts end to end on the driver."""

    def add(key, found):
        total = sum(np.frombuffer(b, np.float64) for b in found.column("numbers").to_pylist())
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "numbers"])

    got = rows.groupBy("part").applyInArrow(add, "part long, numbers binary").toArrow().sort_by("part")
    flat = [np.frombuffer(b, np.float64) for b in got.column("numbers").to_pylist()]
    return np.concatenate(flat).reshape(-1, width) if flat else np.zeros((0, width))


PARTS = 16


def _parts(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int64()), pa.array([p.astype(np.float64).tobytes() for p in np.array_split(matrix, PARTS)], pa.binary())], ["part", "numbers"])


def fit(docs: DataFrame, space: Space) -> Space:
    """Occurrences of each word and number of passages in all of ``docs`` (doc_id, text), then the latent space from all of its passages."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(space)

    def frequencies(batches):
        own = sent.value
        seen, n = np.zeros((own.size, 1)), 0
        for part in slices(batches, PIECE):
            _, _, h, per_row = terms(*utf8(part.column(1)))
            seen[:, 0] += np.bincount(own.hits(h)[1], minlength=own.size)
            n += int((-(-per_row // PASSAGE)).sum())
        yield _parts(np.vstack([seen, [[n]]]))

    got = _summed(docs.mapInArrow(frequencies, "part long, numbers binary"), 1)[:, 0]
    counts, n = (got[:-1], got[-1]) if len(got) else (np.zeros(space.size), 0)
    space.idf = np.log1p((1 + n) / (1 + counts))
    sent = context.broadcast(space)

    def products(batches):
        own = sent.value
        matrix = own.weighted(own.random)
        total = np.zeros((own.size, DRAWN))
        for part in slices(batches, PIECE):
            _, _, h, per_row = terms(*utf8(part.column(1)))
            row = np.repeat(np.arange(len(per_row)), per_row)
            place = np.arange(len(h)) - (np.cumsum(per_row) - per_row)[row]
            passage = np.cumsum(place % PASSAGE == 0) - 1
            k, column = own.hits(h)
            passage = passage[k]
            for first in range(0, int(passage[-1]) + 1 if len(k) else 0, BLOCK):
                lo, hi = np.searchsorted(passage, [first, first + BLOCK])
                if lo == hi:
                    continue
                p, c = passage[lo:hi] - first, column[lo:hi]
                y = row_sums(matrix, c, np.bincount(p))
                order = np.argsort(c, kind="stable")
                seen, times = np.unique(c, return_counts=True)
                total[seen] += row_sums(np.concatenate([y, np.zeros((1, DRAWN), np.float32)]), p[order], times)
        yield _parts(own.idf[:, None] * total)

    total = _summed(docs.mapInArrow(products, "part long, numbers binary"), DRAWN)
    space.solve(total if len(total) else np.zeros((space.size, DRAWN)))
    return space


def anchored(space: Space, k: np.ndarray, word: np.ndarray, per_row: np.ndarray):
    """(row, item, first, last) of each shortest stretch with as many anchors of an item as a leak has; words count from the row's first."""
    count = space.n_anchored[word]
    item = space.anchored[ranges(space.first_anchored[word], count)]
    row = np.repeat(np.repeat(np.arange(len(per_row)), per_row)[k], count)
    place = np.repeat(k, count) - (np.cumsum(per_row) - per_row)[row]
    own = row * len(space.ids) + item
    order = np.argsort(own, kind="stable")
    own, row, item, place = (x[order] for x in (own, row, item, place))
    end = np.arange(len(own)) + space.met[item] - 1
    inside = np.flatnonzero(end < len(own))
    inside = inside[own[end[inside]] == own[inside]]
    inside = inside[place[end[inside]] - place[inside] < space.span[item[inside]]]
    return row[inside], item[inside], place[inside], place[end[inside]]


def close(space: Space, k: np.ndarray, word: np.ndarray, per_row: np.ndarray, held, cosine: float) -> np.ndarray:
    """Which of the ``anchored`` stretches lie in a window that is a candidate for their item (those of short items all do)."""
    row, item, first, last = held
    n = space.length[item]
    good = n <= SHORT
    own = np.flatnonzero(~good)
    # Windows of the item's length, a quarter of it apart, that can be on a leak with this stretch.
    step = np.maximum(1, n[own] // 4)
    begin = np.maximum(0, last[own] - n[own] - step)
    count = np.maximum(0, first[own] - begin) // step + 1
    at = np.repeat(np.arange(len(own)), count)
    start = begin[at] + ranges(np.zeros(len(own), np.int64), count) * step[at]
    base = np.cumsum(per_row) - per_row
    for a in range(0, len(at), 1024):
        part = at[a : a + 1024]
        r, i, w = row[own[part]], item[own[part]], start[a : a + 1024]
        before = np.searchsorted(k, base[r] + w)
        after = np.searchsorted(k, base[r] + np.minimum(w + space.length[i], per_row[r]))
        c = np.maximum(0, after - before)
        x = row_sums(space.project, space.column[word[ranges(before, c)]], c)
        near = (x * space.items[i]).sum(axis=1) >= cosine * np.maximum(np.linalg.norm(x, axis=1), 1e-9)
        good[own[part[near]]] = True
    return good


def stretches(space: Space, k: np.ndarray, word: np.ndarray, per_row: np.ndarray, cosine: float = COSINE):
    """(row, item, first word in the row) of each stretch to compare, of those that ``_best_share`` knows for a whole row."""
    held = anchored(space, k, word, per_row)
    good = close(space, k, word, per_row, held, cosine)
    row, item, first, last = (x[good] for x in held)
    low, high = last - space.span[item] + 1, first
    step = space.step[item]
    low = -(-np.maximum(low, 0) // step)
    high = np.minimum(high, np.maximum(1, per_row[row] - space.span[item] + step) - 1) // step
    count = np.maximum(0, high - low + 1)
    row, item, at = np.repeat(row, count), np.repeat(item, count), ranges(low, count)
    if not len(row):
        return row, item, at
    wide = int(at.max()) + 1
    pair, at = np.divmod(np.unique((row * len(space.ids) + item) * wide + at), wide)
    row, item = np.divmod(pair, len(space.ids))
    return row, item, at * space.step[item]


def leaks(space: Space, data: np.ndarray, offsets: np.ndarray, cosine: float = COSINE) -> dict[int, list[tuple[int, float]]]:
    """By row, the items found in it and how much of each is there."""
    starts, ends, h, per_row = terms(data, offsets)
    own_first = np.cumsum(per_row) - per_row
    text = _FOLD[data]
    out: dict[int, list[tuple[int, float]]] = {}

    def words_of(r: int) -> list[str]:
        own = slice(own_first[r], own_first[r] + per_row[r])
        return [text[s:e].tobytes().decode() for s, e in zip(starts[own].tolist(), ends[own].tolist())]

    if space.short:
        for r in np.flatnonzero((per_row > 0) & (per_row < LEAST_WORDS)).tolist():
            if same := space.short.get(tuple(words_of(r))):
                out[r] = [(i, 1.0) for i in same]
    if not space.ids:
        return out
    row, item, at = stretches(space, *space.known(h), per_row, cosine)
    cache: dict[int, list[str]] = {}
    best: dict[tuple[int, int], float] = {}
    for r, i, a in zip(row.tolist(), item.tolist(), at.tolist()):
        if r not in cache:
            cache = {r: words_of(r)}
        share = _share(space.words[i], cache[r][a : a + int(space.span[i])])
        if share:
            best[r, i] = max(best.get((r, i), 0.0), share)
    for (r, i), share in best.items():
        out.setdefault(r, []).append((space.ids[i], share))
    return out


def span_of(n: int) -> int:
    """Words of a stretch in which an item of n words is looked for."""
    return n + max(4, n // 2)


def step_of(n: int) -> int:
    """Words between two such stretches."""
    return max(1, n // 4)


def _share(item: list[str], stretch: list[str]) -> float:
    """The share of the item that stands in order in a stretch; 0 if it is no leak."""
    n = len(item)
    whole, tail = common_subsequence(item, stretch)
    share = whole / n
    return share if share >= ALONE or (share >= WITH_ANSWER and tail >= 0.8 * min(ANSWER_WORDS, n)) else 0.0


def _best_share(item: list[str], region: list[str]) -> float:
    """The largest share of the item in order within a stretch of the region not much longer than the item; 0 if it is no leak."""
    span, step = span_of(len(item)), step_of(len(item))
    return max(_share(item, region[a : a + span]) for a in range(0, max(1, len(region) - span + step), step))


def contamination(docs: DataFrame, benchmark: DataFrame, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_id (the most complete), share;
    with ``whole`` a struct column ``row`` of all columns of ``docs`` too.

    ``benchmark`` (item_id, text) is read in blocks of ITEMS, so that what every
    task holds is bounded. Items of fewer than LEAST_WORDS words are
    found in texts that have just their words, those without a word in none; texts that are null or empty are clean; repeated rows are
    each returned; an empty table gives no rows and an empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = documents_of(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    blocks = -(-items.count() // ITEMS)
    spaces = []
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        space = Space(own.column("item_id").to_pylist(), own.column("text").to_pylist())
        if space.ids:
            fit(rows, space)
        if space.ids or space.short:
            spaces.append(spark.sparkContext.broadcast(space))

    def run(batches):
        for part in slices(batches, PIECE):
            found: dict[int, list[tuple[int, float]]] = {}
            data, offsets = utf8(part.column(1))
            for sent in spaces:
                for r, own in leaks(sent.value, data, offsets).items():
                    found.setdefault(r, []).extend(own)
            lists = [sorted(found.get(k, []), key=lambda x: (-x[1], x[0])) for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([bool(x) for x in lists]),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.array([x[0][0] if x else None for x in lists], pa.int64()),
                    pa.array([x[0][1] if x else 0.0 for x in lists], pa.float64()),
                    *part.columns[2:],
                ],
                ["doc_id", "contaminated", "n_items", "item_id", "share", *part.schema.names[2:]],
            )

    schema = StructType([StructField("doc_id", LongType()), StructField("contaminated", BooleanType()), StructField("n_items", LongType()), StructField("item_id", LongType()), StructField("share", DoubleType())])
    if not whole:
        return rows.mapInArrow(run, schema)
    rows = keyed(docs, doc_id=docs["doc_id"].cast("long"), text=docs["text"].cast("string"))
    return rows.select("doc_id", "text", "row").mapInArrow(run, schema.add("row", docs.schema))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, each judged by itself and without a shuffle; all columns stay.

    Null and empty texts stay; an empty table gives no rows.
    """
    return contamination(docs, benchmark, whole=True).where("NOT contaminated").select("row.*")
