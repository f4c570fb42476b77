"""Exact Jaccard join of documents on sets of five-word shingles.

The join is a sparse matrix product, documents by shingles, in blocks of shingles:
each block counts what its shingles add to the overlap of pairs, the counts are
summed over the blocks, and pairs whose sum can't reach the overlap that their
sizes call for are discarded; the rest are compared in full.

Documents with equal sets are one row of the matrix (a node). Of each node only the
rarest shingles enter, as many as two linked nodes must share one of. How rare a
shingle is, a sketch of fixed size says, in which the shingles of all nodes are
counted; any order that all nodes agree on gives whole results.

Large groups of near copies would still meet in quadratic numbers: so each node is
first compared with one partner that many others meet too, and afterwards only pairs
between different components of the links found are counted and compared, the closest
of two components first. Before it is counted, a pair has to pass two more bounds: from
how many of the rarest shingles stand in no other node, and from bitmaps of both sets,
where bits that differ stand for shingles that differ. No link between components is missed.
Links inside a component are not all looked at so; ``near_duplicates`` counts them on demand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import documents_of, hot_join, keyed, mix, powers, ready, slices, stage, utf8, word_hashes, words
from .segments import FLUSH, LEAST_BUCKETS, NULL_ID, _pack, _unpack, ranges
from .toxicity import lower

SHINGLE = 5
#: Linked when 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Counters of shingles, whatever the corpus, and the rows that their sums travel in. Shingles that share a counter only look commoner.
COUNTERS, PARTS = 1 << 22, 64
#: Bits of a shingle's hash that name it; how common it is stands above them. Shingles that share a name only add pairs to compare.
NAME_BITS = 48
#: Bits of a node's bitmap: at least so many for each shingle, a power of two, within limits.
BITS, LEAST_BITS, MOST_BITS = 3, 64, 4096
PIECE, PER_BUCKET, PER_GROUP, PER_HUB = 512 << 10, 2 << 20, 4 << 20, 256
#: So many (node, pair) rows of some 50 bytes may be sent to every task.
SENT_ROWS = 250_000
_Q = np.uint64(0xA0761D6478BD642F)
_Q_INV = np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, laid end to end; and their number by row."""
    low = lower(data)
    starts, ends, per_row = words(low, offsets)
    h = word_hashes(low, starts, ends)
    n = len(h)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(_Q, n), out=total[1:])
    long = np.minimum(per_row, SHINGLE)
    count = np.where(per_row > 0, per_row - long + 1, 0)
    first = np.cumsum(per_row) - per_row
    at = ranges(first, count)
    size = np.repeat(long, count)
    value = mix((total[at + size] - total[at]) * powers(_Q_INV, n + 1)[at] + size.astype(np.uint64))
    cuts = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    keep[1:] = value[1:] != value[:-1]
    keep[cuts[:-1][count > 0]] = True
    row = np.repeat(np.arange(len(count)), count)[keep]
    return value[keep], np.bincount(row, minlength=len(count))


def node_numbers(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 63-bit number of each set; 0 for the empty set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(1)), dtype=np.uint64)])
    ends = np.cumsum(sizes)
    number = mix((total[ends] - total[ends - sizes]) + sizes.astype(np.uint64)) >> np.uint64(1)
    return np.where(sizes > 0, np.maximum(number, 1), 0).astype(np.int64)


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least overlap with which sets of these sizes are linked."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_size(n: np.ndarray) -> np.ndarray:
    """So many of its rarest shingles that a linked set must have one of them in its own."""
    return n - (-(-PERCENT * n // 100)) + 1


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of n shingles."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(1, BITS * n))).astype(np.int64), LEAST_BITS, MOST_BITS)


def bitmaps(sets: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Of each set, a bit for each hash modulo its width: whether an odd number of shingles fall on it."""
    width = widths(sizes)
    ends = np.cumsum(width)
    at = np.repeat(ends - width, sizes) + (sets & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip(((ends - width) >> 3).tolist(), (ends >> 3).tolist())]


class Bitmaps:
    """Bitmaps of a block's nodes, folded to the smaller width when two are compared."""

    def __init__(self, bits: list[bytes]):
        width = np.array([8 * len(b) for b in bits], np.int64)
        self.width = width
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(width).tolist():
            own, double = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            both = np.frombuffer(b"".join(bits[k] for k in [*own.tolist(), *double.tolist()]), np.uint64)
            rows = both[: len(own) * (w // 64)].reshape(-1, w // 64)
            wide = both[len(own) * (w // 64) :].reshape(-1, 2, w // 64)
            slot = np.full(len(width), -1, np.int64)
            slot[own] = np.arange(len(own))
            slot[double] = len(own) + np.arange(len(double))
            self.of[w] = slot, np.concatenate([rows, wide[:, 0] ^ wide[:, 1]])

    def differing(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """No more than the number of shingles that only one of two nodes has; widths may differ by one step (sizes of linked sets do not differ more)."""
        out = np.zeros(len(x), np.int64)
        width = np.minimum(self.width[x], self.width[y])
        for w in np.unique(width).tolist():
            own = np.flatnonzero((width == w) & (np.maximum(self.width[x], self.width[y]) <= 2 * w))
            slot, rows = self.of[w]
            step = max(1, (1 << 20) // w)
            for k in range(0, len(own), step):
                at = own[k : k + step]
                out[at] = np.bitwise_count(rows[slot[x[at]]] ^ rows[slot[y[at]]]).sum(axis=1)
        return out


def _survey(rows: DataFrame) -> DataFrame:
    """kind 0: doc_id, node, n, text hash of each row and, once for a task's rows with one node, its bitmap; kind 1: a part of a task's counters."""

    def run(batches):
        names = ["kind", "a", "b", "c", "d", "blob"]
        counter = np.zeros(COUNTERS, np.uint32)
        done: set[int] = set()
        for part in slices(batches, PIECE):
            sets, sizes = shingle_sets(*utf8(part.column(1)))
            nodes = node_numbers(sets, sizes)
            fresh = np.array([k for k, x in enumerate(nodes.tolist()) if x and x not in done and not done.add(x)], np.int64)
            ends = np.cumsum(sizes)
            sets = sets[ranges((ends - sizes)[fresh], sizes[fresh])]  # equal sets of a task count once
            np.add.at(counter, (sets >> np.uint64(20)) & np.uint64(COUNTERS - 1), np.uint32(1))
            bits: list[bytes | None] = [None] * len(nodes)
            for k, own in zip(fresh.tolist(), bitmaps(sets, sizes[fresh])):
                bits[k] = own
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(nodes), np.int64)), part.column(0), pa.array(nodes), pa.array(sizes.astype(np.int64)), part.column(2), pa.array(bits, pa.binary())], names)
            if len(done) > 1 << 18:  # what is counted once more only looks commoner
                done.clear()
        each = COUNTERS // PARTS
        blobs = []
        for k in range(PARTS):
            own = counter[k * each : (k + 1) * each]
            at = np.flatnonzero(own)
            blobs.append(_pack([at, own[at]], rising=1) if len(at) else None)
        zeros = pa.array(np.zeros(PARTS, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(PARTS, np.int64)), pa.array(np.arange(PARTS)), zeros, zeros, zeros, pa.array(blobs, pa.binary())], names)

    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "kind long, a long, b long, c long, d long, blob binary")


def _levels(survey: DataFrame) -> np.ndarray:
    """How common the shingles of each counter are in all nodes: 16 bits each, on a scale of logarithms."""

    def add(key, found):
        total = np.zeros(COUNTERS // PARTS, np.int64)
        for blob in found.column("blob").to_pylist():
            (at, n), _ = _unpack(blob)
            total[at] += n
        level = (np.log2(1.0 + total) * 1024).astype(np.uint16)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([level.tobytes()], pa.binary())], names=["part", "level"])

    parts = survey.where("kind = 1 AND blob IS NOT NULL").select(F.col("a").alias("part"), "blob").groupBy("part").applyInArrow(add, "part long, level binary").toArrow()
    out = np.zeros((PARTS, COUNTERS // PARTS), np.uint16)
    for k, level in zip(parts.column("part").to_pylist(), parts.column("level").to_pylist()):
        out[k] = np.frombuffer(level, np.uint16)
    return out.reshape(-1)


def _incidence(rows: DataFrame, levels: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, packed shingle, node, set size, how common the last of them is) of the rarest shingles of each node."""
    sent = rows.sparkSession.sparkContext.broadcast(levels)  # 2 * COUNTERS bytes

    def run(batches):
        level = sent.value
        held: list[list[np.ndarray]] = []
        done: set[int] = set()
        size = 0

        def packed():
            key, node, n, reach = (np.concatenate(x) for x in zip(*held))
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, node, n, reach, bucket = (x[order] for x in (key, node, n, reach, bucket))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            out = [(int(bucket[a]), _pack([node[a:b], key[a:b].view(np.int64), n[a:b], reach[a:b]])) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["bucket", "blob"])

        for part in slices(batches, PIECE):
            data, offsets = utf8(part.column(1))
            sets, sizes = shingle_sets(data, offsets)
            nodes = node_numbers(sets, sizes)
            fresh = np.array([k for k, x in enumerate(nodes.tolist()) if x and x not in done and not done.add(x)], np.int64)
            size += len(data)
            if len(fresh):
                n = sizes[fresh].astype(np.int64)
                ends = np.cumsum(sizes)
                value = sets[ranges((ends - sizes)[fresh], n)]
                key = level[(value >> np.uint64(20)) & np.uint64(COUNTERS - 1)].astype(np.uint64) << np.uint64(NAME_BITS)
                key |= value >> np.uint64(64 - NAME_BITS)
                cuts = np.concatenate([[0], np.cumsum(n)])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    key[a:b].sort()
                short = prefix_size(n)
                reach = (key[cuts[:-1] + short - 1] >> np.uint64(NAME_BITS)).astype(np.int64)
                held.append([key[ranges(cuts[:-1], short)], np.repeat(nodes[fresh], short), np.repeat(n, short), np.repeat(reach, short)])
            if size >= FLUSH and held:
                yield packed()
                held, size = [], 0
                done.clear()
        if held:
            yield packed()

    return rows.select("doc_id", "text").mapInArrow(run, "bucket long, blob binary")


def _shared(key, found):
    """Of one block, the shingles that more than one node has."""
    node, key, n, reach = (np.concatenate(x) for x in zip(*(_unpack(b)[0] for b in found.column("blob").to_pylist())))
    order = np.lexsort((node, key))
    key, node, n, reach = (x[order] for x in (key, node, n, reach))
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node, n, reach = (x[first] for x in (key, node, n, reach))
    many = np.zeros(len(key), bool)
    many[1:] = key[1:] == key[:-1]
    many[:-1] |= many[1:]
    key, node, n, reach = (x[many] for x in (key, node, n, reach))
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    run = np.cumsum(head) - 1
    met = np.bincount(run)[run] if len(run) else run
    return pa.table([pa.array(x) for x in (key, node, n, reach, met)], names=["shingle", "node", "n", "reach", "met"])


def _behind(n: str):
    """Shingles of a set that don't enter the product."""
    return F.ceil(F.lit(PERCENT) * F.col(n) / 100) - 1


def _product(rows: DataFrame, levels: np.ndarray, buckets: int) -> DataFrame:
    """(shingle, node, n, reach, most, weight) of each shingle that several nodes have among their rarest.

    ``reach``: how common the last of the node's rarest shingles is. ``most``: the largest
    overlap that the node can have with one that reaches farther, as those of its rarest
    shingles that nobody shares are not in such a node. ``weight``: how many others its
    shingles meet.
    """
    shared = stage(_incidence(rows, levels, buckets).groupBy("bucket").applyInArrow(_shared, "shingle long, node long, n long, reach long, met long"), "met")
    nodes = shared.groupBy("node").agg((F.count(F.lit(1)) + F.first(_behind("n"))).alias("most"), F.sum("met").alias("weight"))
    return stage(shared.drop("met").join(nodes, "node"), "shared")


def _enough(c, na: str, nb: str):
    """Whether c shared ones among the rarest leave a link possible: the others lie behind the end of one of the two."""
    return c + F.greatest(_behind(na), _behind(nb)) >= F.ceil(F.lit(PERCENT) * (F.col(na) + F.col(nb)) / (100 + PERCENT))


def _closest(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the pairs between two components, the one that shares most."""
    rooted = _rooted(pairs, roots).groupBy(F.least("ra", "rb").alias("one"), F.greatest("ra", "rb").alias("two"))
    return rooted.agg(F.max(F.struct("c", "a", "b")).alias("best")).select("best.a", "best.b")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components, with their roots."""
    for k, r in (("a", "ra"), ("b", "rb")):
        own = roots.select(F.col("node").alias(k), F.col("root").alias(r))
        pairs = pairs.join(own, k, "left").withColumn(r, F.coalesce(r, k))
    return pairs.where("ra <> rb")


BLOCK = ("shingle", "node", "n", "reach", "most", "root")


def _in_order(found) -> list[np.ndarray]:
    """Columns BLOCK of a block by shingle, component and size."""
    columns = [found.column(c).to_numpy() for c in BLOCK]
    order = np.lexsort((columns[2], columns[5], columns[0]))
    return [order, *(x[order] for x in columns)]


def met(shingle, node, n, reach, most, root):
    """Yields (x, y): rows of a block that share a shingle but not a component, if they are ``bounded`` so that they may be linked."""
    edge = np.append(shingle[1:] != shingle[:-1], True)
    ends = np.flatnonzero(edge) + 1
    own = np.flatnonzero(edge | np.append(root[1:] != root[:-1], True)) + 1
    # Each row meets the rows of its shingle behind those of its own component.
    last = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    begin = np.repeat(own, np.diff(np.concatenate([[0], own])))
    total = np.concatenate([[0], np.cumsum(last - begin)])
    k = 0
    while k < len(node):
        stop = max(k + 1, int(np.searchsorted(total, total[k] + (1 << 18), "right")) - 1)
        here = np.arange(k, stop)
        count = (last - begin)[here]
        x, y = np.repeat(here, count), ranges(begin[here], count)
        k = stop
        good = bounded(n, reach, most, x, y)
        yield x[good], y[good]


def bounded(n, reach, most, x, y) -> np.ndarray:
    """Whether sizes and ``most`` (see ``_product``) let two rows be linked."""
    na, nb = n[x], n[y]
    bound = np.where(reach[x] < reach[y], most[x], np.where(reach[x] > reach[y], most[y], np.maximum(most[x], most[y])))
    return (100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)) & (bound >= needed(na, nb))


def _hubs(key, found):
    """(a, b, c, na, nb): how many of a block's shingles with hub a a node b has."""
    shingle, node, n, reach, most, weight = (found.column(c).to_numpy() for c in (*BLOCK[:5], "weight"))
    order = np.lexsort((node, weight, shingle))
    shingle, node, n, reach, most = (x[order] for x in (shingle, node, n, reach, most))
    ends = np.flatnonzero(np.append(shingle[1:] != shingle[:-1], True))
    hub = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
    own = np.arange(len(node))
    own = np.flatnonzero((node != node[hub]) & bounded(n, reach, most, own, hub))
    own = own[np.lexsort((node[own], node[hub[own]]))]
    a, b = node[hub[own]], node[own]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(own) else own
    count = np.diff(np.append(head, len(own)))
    return pa.table([pa.array(x) for x in (a[head], b[head], count, n[hub[own[head]]], n[own[head]])], names=["a", "b", "c", "na", "nb"])


def _stars(shared: DataFrame, buckets: int) -> DataFrame:
    """Each node with one partner: of the hubs of its shingles, the one that it shares most with.

    The hub of a shingle is its node that meets most others in all: of near copies,
    likely the one closest to their source.
    """
    rows = shared.select(_bucket_of(buckets), *BLOCK[:5], "weight")
    pairs = rows.groupBy("bucket").applyInArrow(_hubs, "a long, b long, c long, na long, nb long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    pairs = pairs.where(_enough(F.col("c"), "na", "nb"))
    return pairs.groupBy("b").agg(F.max(F.struct("c", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")


def _bucket_of(buckets: int):
    return F.pmod(F.xxhash64("shingle"), F.lit(buckets)).alias("bucket")


def _meeting(key, found):
    """The rows of a block that ``met`` has."""
    order, *columns = _in_order(found)
    keep = np.zeros(len(order), bool)
    for x, y in met(*columns):
        keep[x] = keep[y] = True
    return pa.table([pa.array(c[keep]) for c in columns], names=[*BLOCK])


def _counted(key, found):
    """(a, b, c, na, nb): how many of a block's shingles two nodes share, if ``met`` and their bitmaps let them be linked."""
    order, shingle, node, n, reach, most, root = _in_order(found)
    _, first, number = np.unique(node, return_index=True, return_inverse=True)
    maps = Bitmaps(found.column("bits").take(pa.array(order[first])).to_pylist())
    out: list[tuple[np.ndarray, ...]] = []
    held = 0

    def summed():
        a, b, c, na, nb = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((b, a))
        a, b, c, na, nb = (x[order] for x in (a, b, c, na, nb))
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[head], b[head], np.add.reduceat(c, head), na[head], nb[head]

    for x, y in met(shingle, node, n, reach, most, root):
        good = n[x] + n[y] - maps.differing(number[x], number[y]) >= 2 * needed(n[x], n[y])
        x, y = x[good], y[good]
        if len(x):
            swap = node[x] > node[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            out.append((node[x], node[y], np.ones(len(x), np.int64), n[x], n[y]))
            held += len(x)
            if held > 1 << 20:
                out = [summed()]
                held = len(out[0][0])
    return pa.table([pa.array(v) for v in (summed() if out else (np.zeros(0, np.int64),) * 5)], names=["a", "b", "c", "na", "nb"])


def _between(shared: DataFrame, roots: DataFrame, survey: DataFrame, buckets: int) -> DataFrame:
    """Pairs of nodes of different components whose summed overlap counts still let them be linked.

    Each block is gone through twice: first for the rows that meet any other, and, with
    the bitmaps of these alone, for the pairs.
    """
    bucket = _bucket_of(buckets)
    rows = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = stage(rows.select(bucket, *BLOCK).groupBy("bucket").applyInArrow(_meeting, ", ".join(f"{c} long" for c in BLOCK)), "meeting")
    bits = survey.where("kind = 0 AND blob IS NOT NULL").select(F.col("b").alias("node"), "blob")
    bits = bits.join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("blob").alias("bits"))
    rows = rows.join(bits, "node").select(bucket, *BLOCK, "bits")
    pairs = rows.groupBy("bucket").applyInArrow(_counted, "a long, b long, c long, na long, nb long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return pairs.where(_enough(F.col("c"), "na", "nb")).select("a", "b", "c")


def _verify(pairs: DataFrame, rows: DataFrame, lead: DataFrame, groups: int) -> DataFrame:
    """The pairs (a, b) that are linked, as edges (u, v).

    A pair is looked at in the group of its smaller node; a node with many pairs is
    dealt to many groups. Only texts of nodes in a pair move: the list of them is sent
    to the tasks if it is short, and else meets the documents by a merge join.
    """
    hubs = stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_HUB).cast("int").alias("shares")), "hubs")
    group = F.pmod(F.xxhash64("a", "share"), F.lit(groups))
    left = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).select(F.col("a").alias("node"), "a", "share")
    right = pairs.join(hubs, "a").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    wanted = left.union(right).withColumn("g", group).join(lead.select("node", "id", "text_hash"), "node")
    wanted = stage(wanted, "wanted")
    few = wanted.count() <= SENT_ROWS
    wanted = F.broadcast(wanted) if few else wanted.hint("merge")
    own = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    found = own.join(wanted, ["id", "text_hash"]).select("g", "a", "share", "node", "text")

    def run(key, found):
        one = found.column("a").to_numpy() == found.column("node").to_numpy()
        return compare(found.filter(pa.array(one)), found.filter(pa.array(~one)))

    def compare(hub, member):
        out: list[tuple[int, int]] = []
        sets, sizes = shingle_sets(*utf8(hub.column("text")))
        ends = np.cumsum(sizes)
        by = {}
        for k, (a, share) in enumerate(zip(hub.column("a").to_pylist(), hub.column("share").to_pylist())):
            by[a, share] = sets[ends[k] - sizes[k] : ends[k]]
        for batch in slices(member.select(["node", "text", "a", "share"]).to_batches(), PIECE):
            sets, sizes = shingle_sets(*utf8(batch.column(1)))
            ends = np.cumsum(sizes)
            for k, (b, a, share) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                one, two = by[a, share], sets[ends[k] - sizes[k] : ends[k]]
                at = np.minimum(np.searchsorted(one, two), len(one) - 1)
                both = int((one[at] == two).sum())
                if 100 * both >= PERCENT * (len(one) + len(two) - both):
                    out.append((a, b))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["u", "v"])

    return found.groupBy("g").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, count_links: bool = False, hashes: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, and n_links if ``count_links``,
    text_hash (xxhash64) if ``hashes``.

    Words are lower-cased (A-Z). The set of a document holds its distinct five-word
    shingles, or its whole word sequence if it is shorter; without words it is empty
    and linked with nothing. component_id is the smallest doc_id reachable by links,
    its own included. Null texts are empty; null ids never are the smallest; repeated
    rows are each returned; an empty table gives no rows.

    n_links is the number of other rows that a row is linked with, those of an equal set
    included. For it all candidate pairs of different sets are compared, which grows with
    the square of a group of near copies.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = documents_of(docs)
    survey = stage(_survey(rows), "survey")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, groups = (max(LEAST_BUCKETS, math.ceil(total / per)) for per in (PER_BUCKET, PER_GROUP))
    members = survey.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("c").alias("n"), F.col("d").alias("text_hash"))
    shared = _product(rows, _levels(survey), buckets)

    # Of each node the row whose text stands for it.
    lead = members.where("node <> 0").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text_hash")).alias("row"), F.min("doc_id").alias("least_id"), F.count("*").alias("n_rows"))
    lead = stage(lead.select("node", "row.id", "row.text_hash", "least_id", "n_rows"), "lead")
    if count_links:
        nobody = spark.createDataFrame([], "node long, root long")
        links = stage(_verify(stage(_between(shared, nobody, survey, buckets), "pairs"), rows, lead, groups), "links")
        roots = connected_components(links)
    else:
        links = stage(_verify(stage(_stars(shared, buckets), "stars"), rows, lead, groups), "links")
        roots = connected_components(links)
        pairs = stage(_between(shared, roots, survey, buckets), "pairs")
        for pick in (lambda: _closest(pairs, roots), lambda: _rooted(pairs, roots).select("a", "b")):
            more = stage(_verify(stage(pick(), "picked"), rows, lead, groups), "links")
            if not more.isEmpty():
                roots = connected_components(roots.toDF("u", "v").union(more))

    named = lead.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = lead.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least_id").alias("component_id"))
    named = named.join(stage(least, "least"), "root").select("node", "n_rows", "component_id")
    more = []
    if count_links:
        both = links.union(links.select("v", "u")).toDF("node", "other").join(lead.select(F.col("node").alias("other"), F.col("n_rows").alias("n_other")), "other")
        named = named.join(both.groupBy("node").agg(F.sum("n_other").alias("n_links")), "node", "left")
        named = named.withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("n_rows") - 1)
        more = ["n_links"]
    named = stage(named, "named")
    own = ["text_hash"] if hashes else []
    alone = members.where("node = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *(F.lit(0).cast("long").alias(c) for c in more), *own)
    linked = hot_join(members.where("node <> 0"), named, "node", "n_rows")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", *more, *own).unionByName(alone)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component (the smallest doc_id) and all that have no words; all columns stay.

    What goes is decided by doc_id and text: rows whose id repeats, null ids included, don't
    drag each other along. Rows that have the id that stays are all kept. An empty table
    gives no rows.
    """
    found = near_duplicates(docs, hashes=True)
    gone = found.where(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id")))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    own = keyed(docs, id=docs["doc_id"].cast("long"), hash=F.xxhash64(docs["text"].cast("string")))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("hash") == F.col("gone_hash"))
    return own.join(gone.hint("merge"), same, "left_anti").select("row.*")
