"""Substring de-duplication of word windows by super-k-mers.

Consecutive windows of ``WINDOW`` words that share a minimiser (the smallest hash of
``SHORT`` neighbouring words) travel as one packed string, words joined by single
spaces, to the minimiser's bucket. There windows are sorted by hash and windows
with equal hashes compared byte by byte, so counts are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import BLANK, mix, powers, word_hashes, words
from .segments import Windows, covered, ranges, remove_repeats, runs, slide_min

WINDOW, SHORT = 20, 3
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_Q_INV = np.uint64(pow(0xC2B2AE3D27D4EB4F, -1, 1 << 64))


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with each run of white space as one space, and where its words now begin and end."""
    blank = BLANK[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    text = data[keep]
    text[BLANK[text]] = 0x20
    before = np.cumsum(keep)
    return text.tobytes(), before[starts] - 1, before[ends - 1]


def _cut(data: np.ndarray, offsets: np.ndarray):
    starts, ends, per_row = words(data, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < WINDOW:
        return b"", none, none, none, none, none, np.zeros(0, np.uint64)
    h = word_hashes(data, starts, ends)
    short = h[: len(h) - SHORT + 1].copy()
    for k in range(1, SHORT):
        short *= _Q
        short += h[k : len(h) - SHORT + 1 + k]
    mini = slide_min(mix(short), WINDOW - SHORT + 1)
    row = np.repeat(np.arange(len(per_row)), per_row)
    whole = np.flatnonzero(row[: len(row) - WINDOW + 1] == row[WINDOW - 1 :])
    first, count = runs(whole, mini[whole])
    text, begin, end = single_spaced(data, starts, ends)
    at = row[first]
    return text, at, first - (np.cumsum(per_row) - per_row)[at], count, begin[first], end[first + count + WINDOW - 2], mix(mini[first])


def _same(buffer: np.ndarray, offsets: np.ndarray, windows: np.ndarray) -> np.ndarray:
    starts, ends, per_row = words(buffer, offsets)
    h = word_hashes(buffer, starts, ends)
    n = len(h)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(_Q, n), out=total[1:])
    first = np.cumsum(per_row) - per_row
    w = ranges(first, windows)
    key = mix((total[w + WINDOW] - total[w]) * powers(_Q_INV, n + 1)[w])
    group = np.full(len(w), -1, np.int64)
    order = np.argsort(key)
    key = key[order]
    equal = key[1:] == key[:-1]
    many = np.zeros(len(key), bool)
    many[1:] |= equal
    many[:-1] |= equal
    order, key = order[many], key[many]
    if not len(order):
        return group
    head = np.concatenate([[True], key[1:] != key[:-1]])
    number = np.cumsum(head) - 1
    lead = order[np.flatnonzero(head)[number]]
    begin, end = starts[w], ends[w + WINDOW - 1]
    size = end - begin
    exact = bool((size[order] == size[lead]).all())
    for k in range(0, len(order) if exact else 0, 1 << 14):
        a, b = order[k : k + (1 << 14)], lead[k : k + (1 << 14)]
        if not np.array_equal(buffer[ranges(begin[a], size[a])], buffer[ranges(begin[b], size[b])]):
            exact = False
            break
    if exact:
        group[order] = number
    else:  # different windows with one hash: number them by their bytes
        text, known = buffer.tobytes(), {}
        for k in order.tolist():
            group[k] = known.setdefault(text[begin[k] : end[k]], len(known))
    return group


def _finish(data: np.ndarray, offsets: np.ndarray, removed: list[tuple[np.ndarray, np.ndarray]]):
    starts, ends, per_row = words(data, offsets)
    text, begin, end = single_spaced(data, starts, ends)
    bytes_ = np.frombuffer(text, np.uint8)
    n_removed, sha = [], []
    at = 0
    for n, (a, b) in zip(per_row.tolist(), removed):
        gone = covered(n, a, b) if len(a) else None
        n_removed.append(int(gone.sum()) if gone is not None else 0)
        if not n:
            kept = b""
        elif gone is None:
            kept = text[begin[at] : end[at + n - 1]]
        else:
            stay = at + np.flatnonzero(~gone)
            size = end[stay] - begin[stay] + 1
            kept = bytes_[np.minimum(ranges(begin[stay], size), len(bytes_) - 1)]
            if len(stay):
                kept = kept.copy()
                kept[np.cumsum(size) - 1] = 0x20
            kept = kept[:-1].tobytes()
        sha.append(hashlib.sha256(kept).hexdigest())
        at += n
    return per_row.tolist(), n_removed, sha


def remove_repeated_windows(docs: DataFrame) -> DataFrame:
    """Drop every word in a window of 20 words whose sequence also starts earlier.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined
    by one space). Earlier: in a document with a smaller doc_id, or before it in the
    same one; all is judged on the input. Null and empty texts have no words; texts
    of fewer than 20 words lose none; a null id comes before all others; rows with
    one id and different texts are not earlier than each other, and repeated rows
    get the same answer each. An empty table gives no rows.
    """
    return remove_repeats(docs, Windows(WINDOW, True, _cut, _same, _finish, "n_words long, n_removed long, kept_sha256 string"))
