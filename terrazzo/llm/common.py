"""Helpers that the text operators share: durable staging, input shaping, Arrow text buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import ready, scratch_dir, stage

__all__ = [
    "BLANK", "bounded_sample", "documents_of", "held_out", "hot_join", "keyed", "mix", "powers", "read", "ready",
    "scratch_dir", "slices", "stage", "utf8", "word_hashes", "words",
]

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents_of(docs: DataFrame) -> DataFrame:
    """The two columns that text operators look at, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside keys of its columns, so that no name of a column can clash with a key's."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in keys.items()))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text falls in fold 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def bounded_sample(rows: DataFrame, per_class: int, label: str) -> DataFrame:
    """About ``per_class`` rows of each value of ``label``, chosen by a hash of doc_id.

    The expected size is at most ``per_class`` times the number of labels, which
    are few (languages, grades); the count per label is one small aggregate.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(draw < share)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column laid end to end, and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches, max_bytes: int, text: int = 1):
    """Cut Arrow batches into pieces of about ``max_bytes`` of text (a longer row is a piece of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + max_bytes, "right")) - 1
            end = min(batch.num_rows, max(end, begin + 1))
            yield batch.slice(begin, end - begin)
            begin = end


#: Bytes that separate words: space and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and how many words each row has. Words never cross rows."""
    solid = ~BLANK[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid
    last[:-1] &= BLANK[data[1:]] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    per_row = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, per_row


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
#: Entries of a table that a worker keeps; a longer text has one made for it.
KEPT = 1 << 20


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; a table of up to KEPT is kept and grown in steps."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n else 1
        have = np.full(size if size <= KEPT else n, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= KEPT:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word, the same wherever the word stands."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_P_INV, n + 1)[starts])



def hot_join(rows: DataFrame, table: DataFrame, key: str, n_rows: str, share: float = 0.001) -> DataFrame:
    """Inner join of ``rows`` with one row per ``key`` of ``table``, even if one key has most of the rows.

    ``n_rows`` is the column of ``table`` with the number of rows of a key. Keys with
    more than ``share`` of all rows (fewer than 1 / share of them) are joined by
    broadcast, the others by shuffle. ``table`` should be staged.
    """
    total = table.agg(F.sum(n_rows)).first()[0] or 0
    hot = F.col(n_rows) > total * share + 1
    few = F.broadcast(table.where(hot))
    cold = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.join(table.where(~hot), key))
