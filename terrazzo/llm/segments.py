"""Exact search for repeated fixed-length windows by travelling segments.

Used with windows of words (``substring_dedup``) and of bytes (``suffix_dedup``).
Every window has a minimiser, the smallest rolling hash of the short strings in it,
so equal windows have equal minimisers. Consecutive windows with one minimiser
travel as one string (a segment) to the bucket of that minimiser. Equal segments of
a task are merged before they leave it: a passage that a third of the corpus shares
leaves each task once, so no bucket grows with it. In a bucket the distinct
segments are compared window by window; what is a repeat goes back to its document
as intervals.

Strings of a task and bucket are packed into one compressed value. Rows are known by
doc_id and, where any id stands on several rows, a 64-bit hash of the text, so that
they don't mix.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, mix, ready, slices, utf8

#: Bytes of text that are looked at together, that a task packs together, and that a bucket and a group of documents hold.
PIECE, FLUSH, PER_BUCKET, PER_GROUP = 512 << 10, 8 << 20, 2 << 20, 8 << 20
LEAST_BUCKETS = 64
#: Of zstd.
LEVEL = 6
#: Order of a null doc_id: before every other.
NULL_ID = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Windows:
    """How to cut and compare. ``within``: a window also repeats an earlier one of its own document."""

    size: int
    within: bool
    #: (data, offsets) -> buffer, and of each segment: row, first window, number of windows, begin and end in the buffer, minimiser.
    cut: Callable
    #: (buffer, begin of each segment, windows of each) -> group number of each window, in order of segments; -1: alone.
    same: Callable
    #: (data, offsets, removed intervals per row) -> output columns after doc_id.
    finish: Callable
    output: str


def slide_min(a: np.ndarray, k: int) -> np.ndarray:
    """Smallest of each k neighbours."""
    p = 1
    while 2 * p <= k:
        a = np.minimum(a[:-p], a[p:])
        p *= 2
    return np.minimum(a[: len(a) - (k - p)], a[k - p :]) if p < k else a


def runs(windows: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending window numbers, the first and the length of each unbroken run with one key."""
    if not len(windows):
        return windows, windows
    new = np.flatnonzero((np.diff(windows) != 1) | (key[1:] != key[:-1])) + 1
    first = np.concatenate([[0], new])
    return windows[first], np.diff(np.concatenate([first, [len(windows)]]))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def _pack(arrays: list[np.ndarray], tail: bytes = b"", rising: int = 0) -> bytes:
    """One compressed value of whole numbers and text. The first ``rising`` arrays are kept as differences; equal bytes of numbers lie together."""
    head = [np.array([len(arrays), rising, *(len(a) for a in arrays)], np.int64).tobytes()]
    for k, a in enumerate(arrays):
        a = np.ascontiguousarray(a, np.int64)
        if k < rising:
            a = np.diff(a, prepend=np.int64(0))
        head.append(a.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([*head, tail]))


def _unpack(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, rising = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16 + 8 * n, []
    for k, s in enumerate(np.frombuffer(raw, np.int64, n, 16).tolist()):
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * s, at).reshape(8, s).T).view(np.int64).reshape(s)
        out.append(np.cumsum(a) if k < rising else a)
        at += 8 * s
    return out, raw[at:]


def _prime(n: int) -> int:
    """The smallest prime from n on: no regular step in the ids makes groups uneven."""
    while any(n % k == 0 for k in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def _group(doc: np.ndarray, row: np.ndarray, groups: int) -> np.ndarray:
    """Group of documents that finishes each row: rows with one id, null too, are dealt by their texts."""
    return (mix(doc.view(np.uint64) * _ODD + row.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _pack_by(key: np.ndarray, arrays: list[np.ndarray]):
    """(value of key, packed rows) for each value."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
    arrays = [a[order] for a in arrays]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(key[a]), _pack([x[a:b] for x in arrays], rising=1)


def _merge(strings: list[bytes], doc: np.ndarray, row: np.ndarray, start: np.ndarray, within: bool):
    """Merge equal strings. Returns the number of the string of each instance, the distinct strings, decided repeats, instances still open."""
    order = np.lexsort((start, row, doc))
    number: dict[bytes, int] = {}
    which = np.empty(len(strings), np.int64)
    for k in order.tolist():
        which[k] = number.setdefault(strings[k], len(number))
    first = np.full(len(number), -1, np.int64)
    first[which[order[::-1]]] = order[::-1]
    lead = first[which]
    later = doc > doc[lead]
    if within:
        later |= (doc == doc[lead]) & (row == row[lead]) & (start > start[lead])
    again = (np.arange(len(strings)) != lead) & (doc == doc[lead]) & (row == row[lead]) & (start == start[lead])
    return which, list(number), later, ~later & ~again


class _Sender:
    """Collects the segments of a task and packs them by bucket."""

    def __init__(self, kind: Windows, buckets: int, groups: int):
        self.kind, self.buckets, self.groups = kind, buckets, groups
        self.clear()

    def clear(self) -> None:
        self.strings: list[bytes] = []
        self.parts: list[list[np.ndarray]] = []
        self.bytes = 0

    def add(self, doc: np.ndarray, row: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        self.bytes += len(data)
        buffer, at, start, count, begin, end, mini = self.kind.cut(data, offsets)
        if len(at):
            self.strings += [buffer[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            self.parts.append([doc[at], row[at], start, count, (mini % np.uint64(self.buckets)).astype(np.int64)])

    def rows(self):
        if not self.strings:
            return
        doc, row, start, count, bucket = (np.concatenate(x) for x in zip(*self.parts))
        which, strings, later, open_ = _merge(self.strings, doc, row, start, self.kind.within)
        k = np.flatnonzero(later)
        for g, blob in _pack_by(_group(doc[k], row[k], self.groups), [doc[k], row[k], start[k], start[k] + count[k] + self.kind.size - 1]):
            yield -1 - g, blob
        k = np.flatnonzero(open_)
        k = k[np.lexsort((which[k], bucket[k]))]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[k])) + 1, [len(k)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = k[a:b]
            used, at = np.unique(which[own], return_inverse=True)
            texts = [strings[u] for u in used.tolist()]
            more = np.array([len(t) for t in texts])
            more[at] = more[at] - count[own]  # of byte windows always the same
            yield int(bucket[own[0]]), _pack([at, doc[own], row[own], start[own], count[own], more], b"".join(texts), 2)
        self.clear()


def _bucket(kind: Windows, groups: int, blobs: list[bytes]):
    """Compare the segments of one bucket; yields (document group, packed intervals)."""
    strings: list[bytes] = []
    parts: list[list[np.ndarray]] = []
    for blob in blobs:
        (at, doc, row, start, count, more), text = _unpack(blob)
        sizes = more.copy()
        sizes[at] = more[at] + count
        ends = np.cumsum(sizes)
        own = [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]
        strings += [own[k] for k in at.tolist()]
        parts.append([doc, row, start, count])
    doc, row, start, count = (np.concatenate(x) for x in zip(*parts))
    which, distinct, later, open_ = _merge(strings, doc, row, start, kind.within)
    found = [[doc[later], row[later], start[later], start[later] + count[later] + kind.size - 1]]
    windows = np.zeros(len(distinct), np.int64)
    windows[which] = count
    sizes = np.array([len(s) for s in distinct], np.int64)
    buffer = np.frombuffer(b"".join(distinct), np.uint8)
    group = kind.same(buffer, np.concatenate([[0], np.cumsum(sizes)]), windows)
    base = np.cumsum(windows) - windows
    # Windows of the open instances that share their group with another.
    k = np.flatnonzero(open_)
    instance = np.repeat(k, count[k])
    offset = ranges(np.zeros(len(k), np.int64), count[k])
    g = group[base[which[instance]] + offset]
    shared = np.flatnonzero(g >= 0)
    instance, offset, g = instance[shared], offset[shared], g[shared]
    if len(g):
        d, r, s = doc[instance], row[instance], start[instance] + offset
        order = np.lexsort((s, r, d, g))
        instance, offset, g, d, r, s = (x[order] for x in (instance, offset, g, d, r, s))
        head = np.concatenate([[True], g[1:] != g[:-1]])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        again = d > d[lead]
        if kind.within:
            own_head = head | np.concatenate([[True], (d[1:] != d[:-1]) | (r[1:] != r[:-1])])
            own = np.flatnonzero(own_head)[np.cumsum(own_head) - 1]
            again |= s > s[own]
        instance, offset = instance[again], offset[again]
        order = np.lexsort((offset, instance))
        instance, offset = instance[order], offset[order]
        if len(offset):
            new = np.flatnonzero((np.diff(instance) != 0) | (np.diff(offset) != 1)) + 1
            first = np.concatenate([[0], new])
            last = np.concatenate([new, [len(offset)]]) - 1
            i = instance[first]
            found.append([doc[i], row[i], start[i] + offset[first], start[i] + offset[last] + kind.size])
    doc, row, a, b = (np.concatenate(x) for x in zip(*found))
    if len(doc):
        yield from _pack_by(_group(doc, row, groups), [doc, row, a, b])


def covered(length: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``length`` positions lie in an interval."""
    step = np.bincount(begin, minlength=length + 1)[: length + 1] - np.bincount(end, minlength=length + 1)[: length + 1]
    return np.cumsum(step[:length]) > 0


def remove_repeats(docs: DataFrame, kind: Windows) -> DataFrame:
    """One row per row of ``docs``: doc_id and what ``kind.finish`` makes of its text and the repeats in it."""
    spark = docs.sparkSession
    ready(spark)
    rows = documents_of(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(total / PER_BUCKET))
    groups = _prime(max(LEAST_BUCKETS, math.ceil(total / PER_GROUP)))
    # Ids that stand on one row each need no hash of the text beside them.
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    rows = rows.withColumn("row", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])

    def table(found) -> pa.RecordBatch:
        found = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], schema=schema)

    def send(batches):
        sender = _Sender(kind, buckets, groups)
        for part in slices(batches, PIECE):
            doc = part.column(0).fill_null(NULL_ID).to_numpy()
            row = part.column(2).to_numpy()
            sender.add(doc, row, *utf8(part.column(1)))
            if sender.bytes >= FLUSH:
                yield table(sender.rows())
        yield table(sender.rows())

    def compare(key, found):
        number, blobs = key[0].as_py(), found.column("blob").to_pylist()
        if number < 0:  # decided before they left their task
            return pa.Table.from_batches([table((-1 - number, b) for b in blobs)]).rename_columns(["part", "blob"])
        return pa.Table.from_batches([table(_bucket(kind, groups, blobs))]).rename_columns(["part", "blob"])

    names = [c.split()[0] for c in kind.output.split(", ")]

    def finish(key, texts, marks):
        found = [_unpack(b)[0] for b in marks.column("blob").to_pylist()]
        mark_doc, mark_row, begin, end = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((mark_row, mark_doc))
        mark_doc, mark_row, begin, end = (x[order] for x in (mark_doc, mark_row, begin, end))
        out: list[list] = [[] for _ in names]
        ids = []
        for batch in slices(texts.to_batches(), PIECE):
            doc = batch.column(0).fill_null(NULL_ID).to_numpy()
            row = batch.column(2).to_numpy()
            lo, hi = np.searchsorted(mark_doc, doc, "left"), np.searchsorted(mark_doc, doc, "right")
            own = []
            for r, a, b in zip(row, lo, hi):
                k = slice(a, b) if a == b or (mark_row[a] == r and mark_row[b - 1] == r) else a + np.flatnonzero(mark_row[a:b] == r)
                own.append((begin[k], end[k]))
            for column, values in zip(out, kind.finish(*utf8(batch.column(1)), own), strict=True):
                column += values
            ids += batch.column(0).to_pylist()
        return pa.table([pa.array(ids, pa.int64()), *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in out)], names=["doc_id", *names])

    sent = rows.select("doc_id", "text", "row").mapInArrow(send, "bucket long, blob binary")
    marks = sent.groupBy("bucket").applyInArrow(compare, "part long, blob binary")

    def dealt(batches):
        for batch in batches:
            part = _group(batch.column(0).fill_null(NULL_ID).to_numpy(), batch.column(2).to_numpy(), groups)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int64())], ["doc_id", "text", "row", "part"])

    texts = rows.select("doc_id", "text", "row").mapInArrow(dealt, "doc_id long, text string, row long, part long")
    return texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(finish, f"doc_id long, {kind.output}")
