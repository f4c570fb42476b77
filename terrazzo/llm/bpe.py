"""Byte-level BPE: exact linear-time encoding by backtracking, decoding by an offset table.

A piece of text is covered greedily with the longest token that starts at each
position (one Aho-Corasick pass finds them all). A token is accepted after its
left neighbour only if the two are compatible: merging the bytes of both by rank
gives back exactly these two. Where no token fits, the neighbour is taken back and
the position is never tried again, so a piece costs time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents_of, ready, slices

#: Distinct pieces of text whose ids a worker remembers before it starts afresh.
REMEMBERED = 100_000


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others are numbered from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    def __init__(self, spec: str):
        import ahocorasick

        made = json.loads(spec)
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in made["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for k, pair in enumerate(made["model"]["merges"]):
            left, right = (bytes(letters[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.rank[vocab[left], vocab[right]] = (k, vocab[left + right])
        #: Rank and parts of the merge that makes a token.
        self.made: dict[int, tuple[int, int, int] | None] = dict.fromkeys(vocab.values())
        for (left, right), (k, i) in self.rank.items():
            if self.made[i] is None:
                self.made[i] = (k, left, right)
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        count = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * count
        for token, i in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.token[i] = token
        # Only what merging the token's own bytes gives back can stand in an encoding.
        self.own = [False] * count
        for token, i in vocab.items():
            self.own[i] = self.merged(token) == [i]
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if self.own[i]:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.automaton.make_automaton()
        self.shorter: list[int] = [-1] * count
        for token, i in vocab.items():
            for n in range(len(token) - 1, 0, -1):
                j = vocab.get(token[:n])
                if j is not None and self.own[j]:
                    self.shorter[i] = j
                    break
        self.table: dict[tuple[int, int], bool] = {}
        self.pattern = regex.compile(PIECES)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.length = [len(t) for t in self.token]
        sizes = np.array(self.length, np.int64)
        self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
        self.blob = np.frombuffer(b"".join(self.token), np.uint8)
        self.seen: dict[str, tuple[bytes, str]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Merge by rank, one pair at a time; only for the tokens of the vocabulary, once each."""
        ids = [self.byte_id[b] for b in piece]
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both, merged by rank, give these two tokens.

        Merging is run backwards at the border: the later of the two border tokens
        is taken apart again and again, and no pair that once stood at the border
        may have had a merge due before the one that took a part of it away (of
        equal merges the left one comes first).
        """
        known = self.table.get((left, right))
        if known is not None:
            return known
        a, b, due, known = left, right, 1 << 60, True
        while True:
            pair = self.rank.get((a, b))
            if pair is not None and pair[0] < due:
                known = False
                break
            made_a, made_b = self.made[a], self.made[b]
            if made_a is None and made_b is None:
                break
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                due, a = made_a[0], made_a[2]
            else:
                due, b = made_b[0] + 1, made_b[1]
        self.table[left, right] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        # Of the tokens that start at a place, the automaton reports the longest last.
        for end, (i, before) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = i
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        length, shorter, table = self.length, self.shorter, self.table.get
        at, left, candidate = 0, -1, longest[0] if n else -1
        while at < n:
            while candidate >= 0:
                end = at + length[candidate]
                if open_[end]:
                    fits = left < 0 or table((left, candidate))
                    if fits or (fits is None and self.compatible(left, candidate)):
                        break
                candidate = shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                at, left = end, candidate
                candidate = longest[at] if at < n else -1
            else:
                open_[at] = 0
                candidate = out.pop()
                at -= length[candidate]
                left = out[-1] if out else -1
        return out

    def _piece(self, piece: str) -> tuple[bytes, str]:
        ids = self.encode_piece(piece.encode())
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        if len(self.table) >= 5 * REMEMBERED:
            self.table.clear()
        value = array("I", ids).tobytes(), ",".join(map(str, ids))
        if len(piece) <= 64:
            self.seen[piece] = value
        return value

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """Token ids, and the same in decimal with commas between."""
        found: list[tuple[bytes, str]] = []
        seen, piece = self.seen.get, self._piece
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                i = self.special[part]
                found.append((np.uint32(i).tobytes(), str(i)))
            else:
                split = self.pattern if not part.isascii() and _not_latin.search(part) else _latin_pieces
                found += [seen(p) or piece(p) for p in split.findall(part)]
        return np.frombuffer(b"".join([f[0] for f in found]), np.uint32), ",".join([f[1] for f in found])

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends) or not ends[-1]:
            return b""
        return self.blob[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


#: Fixed: how byte-level BPE splits text before merging (contractions, words, numbers, signs, white space).
#: White space is spelled out: the modules' \s also takes U+001C to U+001F, which this vocabulary's own splitter doesn't.
_SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same split for texts of ASCII and Latin letters only, by the faster module.
_LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ʯ"
LATIN_PIECES = rf" ?[{_LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
_latin_pieces, _not_latin = re.compile(LATIN_PIECES), re.compile(rf"[^\x00-\x7f{_LATIN}]")

_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def _lists(rows) -> pa.Array:
    return pa.array([ids.astype(np.int32) for ids, _ in rows], pa.list_(pa.int32()))


def encode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Encode each whole text and decode it again, row by row, without a shuffle.

    Returns doc_id, ids (array of int), decoded (text). ``tokenizer_file`` is a
    byte-level BPE description that the driver reads; its content (a few MB,
    whatever the input) goes to the workers as a broadcast variable. Null and empty
    texts give no ids; repeated rows are each returned; an empty table gives no rows.
    """
    return _mapped(docs, tokenizer_file, False)


def encode_digests(docs: DataFrame, tokenizer_file: str, with_ids: bool = False) -> DataFrame:
    """``encode`` with the ids and the decoded text reduced to doc_id, n_tokens, ids_sha256, decoded_sha256; ids too if ``with_ids``."""
    return _mapped(docs, tokenizer_file, True, with_ids)


def _mapped(docs: DataFrame, tokenizer_file: str, digests: bool, with_ids: bool = False) -> DataFrame:
    spark = docs.sparkSession
    ready(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def sha(b: bytes) -> str:
        return hashlib.sha256(b).hexdigest()

    def run(batches):
        own = encoder(spec.value)
        for part in slices(batches, 1 << 20):
            rows = [own.encode(t or "") for t in part.column(1).to_pylist()]
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(ids) for ids, _ in rows], pa.int64()),
                        pa.array([sha(text.encode()) for _, text in rows], pa.string()),
                        pa.array([sha(own.decode(ids).encode()) for ids, _ in rows], pa.string()),
                        *([_lists(rows)] if with_ids else []),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])],
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(rows), pa.array([own.decode(ids) for ids, _ in rows], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids if digests else "doc_id long, ids array<int>, decoded string"
    return documents_of(docs).mapInArrow(run, kind)
