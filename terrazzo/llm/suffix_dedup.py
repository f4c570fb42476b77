"""Removal of long repeated byte strings by prefix-free parsing.

A window of ``LENGTH`` bytes has a trigger: the first place in it whose rolling hash of
``TRIGGER`` bytes is the smallest. (Hashes below a threshold, as usual, would leave
windows without any.) A text falls into phrases that each end with a trigger; what
follows a trigger is a suffix of the parse. A window is a suffix of the phrase that
ends with its trigger and the beginning of the parse suffix behind it, and as its
trigger follows from the window alone, equal windows are cut at the same place. So the
order of all windows falls apart by triggers: phrases and what follows them are dealt
by trigger (see ``segments``), each distinct string of a task once.

In a part the distinct phrases (the dictionary) are sorted from their ends, so that
each suffix of a phrase is an unbroken run of them, and the suffixes of the parse are
sorted by their bytes to the depth that windows need. Both orders are combined: windows
in the order of phrase suffix and parse suffix have equal strings side by side, and
the common bytes of neighbours in the two orders tell whether they are equal. No window is
sorted by its bytes: repetitive text costs little, as a phrase is sorted once.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .common import _P, _P_INV, mix, powers
from .segments import Windows, covered, remove_repeats, runs, slide_min

LENGTH, TRIGGER = 50, 8
#: Bytes of segments that are hashed together.
PIECE = 1 << 20
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the TRIGGER bytes from each place on, the same wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=total[1:])
    return mix((total[TRIGGER:] - total[:-TRIGGER]) * powers(_P_INV, n - TRIGGER + 1))


def _cut(data: np.ndarray, offsets: np.ndarray):
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return b"", none, none, none, none, none, np.zeros(0, np.uint64)
    mini = slide_min(_rolling(data), LENGTH - TRIGGER + 1)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    whole = np.flatnonzero(row[: n - LENGTH + 1] == row[LENGTH - 1 :])
    first, count = runs(whole, mini[whole])
    at = row[first].astype(np.int64)
    return data.tobytes(), at, first - offsets[at], count, first, first + count + LENGTH - 1, mix(mini[first])


def phrases(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the segments laid end to end: each trigger's place, the phrase's length to the trigger's end, and the segment."""
    found = []
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        starts, sizes = offsets[a:b] - offsets[a], np.diff(offsets[a : b + 1])
        rolling = _rolling(buffer[offsets[a] : offsets[b]])
        for back in range(1, TRIGGER):  # strings that go on into the next segment
            rolling[(starts + sizes)[:-1] - back] = _NEVER
        place = np.flatnonzero(rolling == np.repeat(np.minimum.reduceat(rolling, starts), sizes)[: len(rolling)])
        segment = np.searchsorted(starts, place, "right") - 1
        begin = starts[segment]
        begin[1:] = np.where(segment[1:] == segment[:-1], place[:-1] + 1, begin[1:])
        found.append((place + offsets[a], place + TRIGGER - begin, segment + a))
        a = b
    return tuple(np.concatenate(x) for x in zip(*found))


def _strings(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray, words: int, back: bool) -> np.ndarray:
    """Strings of up to 8 * words bytes, forwards or (from ``begin`` + size) backwards, as numbers whose order is theirs; filled up with zeros."""
    out = np.zeros((words, len(begin)), np.uint64)
    for k in range(8 * words):
        live = np.flatnonzero(size > k)
        if not len(live):
            break
        at = begin[live] + (size[live] - 1 - k if back else k)
        out[k // 8, live] |= buffer[at].astype(np.uint64) << np.uint64(56 - 8 * (k % 8))
    return out


def sorted_strings(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, and how many bytes each has in common with the one before it in that order (the first: -1)."""
    order = np.lexsort(strings[::-1])
    before, after = strings[:, order[:-1]], strings[:, order[1:]]
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        differ = before ^ after
        word = (differ != 0).argmax(axis=0)
        first = differ[word, np.arange(differ.shape[1])]
        equal = first == 0
        # Of a number's eight bytes, the first that isn't zero.
        byte = np.zeros(len(first), np.int64)
        for k in range(1, 8):
            byte += first < np.uint64(1 << (64 - 8 * k))
        common[1:] = np.where(equal, 8 * len(strings), 8 * word + byte)
    return order, common


def _same(buffer: np.ndarray, offsets: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Number of each window of the segments, equal for equal windows; -1: no other is equal."""
    group = np.full(int(windows.sum()), -1, np.int64)
    if not len(group):
        return group
    place, size, segment = phrases(buffer, offsets)
    size = np.minimum(size, LENGTH)
    base = (np.cumsum(windows) - windows)[segment] - offsets[:-1][segment]
    last = offsets[:-1][segment] + windows[segment]
    rest = np.minimum(offsets[1:][segment] - place - TRIGGER, LENGTH - TRIGGER)
    dictionary, shared = sorted_strings(_strings(buffer, place + TRIGGER - size, size, -(-LENGTH // 8), True))
    parse, common = sorted_strings(_strings(buffer, place + TRIGGER, rest, -(-(LENGTH - TRIGGER) // 8), False))
    n = len(place)
    rank = np.empty((2, n), np.int64)
    done = 0
    for length in range(TRIGGER, LENGTH + 1):
        # Windows whose phrase suffix has this length: their first byte lies that far before the trigger's end.
        own = np.flatnonzero((size >= length) & (place + TRIGGER - length < last))
        if len(own) < 2:
            continue
        rank[0, dictionary] = np.cumsum(shared < length)
        rank[1, parse] = np.cumsum(common < LENGTH - length)
        key = rank[0, own] * (n + 1) + rank[1, own]
        order = np.argsort(key)
        key = key[order]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        many = ~(head & np.concatenate([head[1:], [True]]))
        own = own[order[many]]
        group[base[own] + place[own] + TRIGGER - length] = done + np.cumsum(head)[many]
        done += n
    return group


def _finish(data: np.ndarray, offsets: np.ndarray, removed: list[tuple[np.ndarray, np.ndarray]]):
    n_removed, n_spans, sha = [], [], []
    for a, b, (begin, end) in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed):
        text = data[a:b]
        if len(begin):
            gone = covered(b - a, begin, end)
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            text = text[~gone]
        else:
            n_removed.append(0)
            n_spans.append(0)
        sha.append(hashlib.sha256(text.tobytes()).hexdigest())
    return np.diff(offsets).tolist(), n_removed, n_spans, sha


def remove_repeated_strings(docs: DataFrame) -> DataFrame:
    """Drop each byte covered by a string of 50 bytes that also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.
    Matches never cross documents, overlaps count, and all is judged on the input.
    Null texts are empty; texts under 50 bytes lose nothing; a null id comes before
    all others; rows with one id are not before each other. An empty table gives no
    rows.
    """
    return remove_repeats(docs, Windows(LENGTH, False, _cut, _same, _finish, "n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
