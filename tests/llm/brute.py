"""Plain single-machine versions of the operators, to test against."""

import hashlib
import re


def word_windows(docs, k=20):
    """docs: [(doc_id, text)] with distinct ids -> {doc_id: (n_words, n_removed, sha)}"""
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first, out = {}, {}
    for d in sorted(split):
        w = split[d]
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            s = tuple(w[i : i + k])
            if s in first:
                gone[i : i + k] = [True] * k
            else:
                first[s] = (d, i)
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def byte_strings(docs, k=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        own = [b[i : i + k] for i in range(len(b) - k + 1)]
        for i, s in enumerate(own):
            if s in seen:
                gone[i : i + k] = b"\1" * k
        seen.update(own)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def jaccard_components(docs, k=5, percent=75):
    """{doc_id: (n_shingles, component_id)}"""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets, by = {}, {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for d, own in sets.items():
        overlap = {}
        for s in own:
            for e in by[s]:
                if e < d:
                    overlap[e] = overlap.get(e, 0) + 1
        for e, n in overlap.items():
            if 100 * n >= percent * (len(own) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}
