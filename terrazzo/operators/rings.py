"""Boundary edges of regions and their assembly into rings.

Every side of a pixel whose neighbour is not of its region is a directed edge with the
region on its right. At a corner where a region touches itself the path turns right,
so each edge has one successor and the edges of a region form cycles. Cycles are found
for many regions at once by pointer doubling, not by walking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.affine import Affine
from ..functions.geometry import RINGS
from ..staging import ready

#: Regions are assembled together in so many groups for each shuffle partition at least, and in as many more as edges call for.
GROUPS_PER_PARTITION, PER_GROUP = 2, 1 << 19


def boundary_edges(labels: DataFrame) -> DataFrame:
    """One row per directed edge: raster_id, region_id, x0, y0, x1, y1, dir (0 right, 1 down, 2 left, 3 up), pos, value."""
    c, r, s = F.col("col"), F.col("row"), F.col("sides")

    def edge(bit, x0, y0, x1, y1, d):
        return F.when(s.bitwiseAND(bit) != 0, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(d).alias("dir")))

    edges = F.array(edge(1, c, r, c + 1, r, 0), edge(2, c + 1, r, c + 1, r + 1, 1), edge(4, c + 1, r + 1, c, r + 1, 2), edge(8, c, r + 1, c, r, 3))
    rows = labels.where("sides <> 0").select("raster_id", "region_id", "pos", "value", F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e"))
    return rows.select("raster_id", "region_id", "e.x0", "e.y0", "e.x1", "e.y1", "e.dir", "pos", "value")


def cycles(successor: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a permutation, the element of smallest ``rank`` of each element's cycle, and the steps from it to the element."""
    n = len(successor)
    order = np.empty(n, np.int64)
    order[np.argsort(rank, kind="stable")] = np.arange(n)
    who = np.empty(n, np.int64)
    who[order] = np.arange(n)
    low, jump = order.copy(), successor.copy()
    while True:
        new = np.minimum(low, low[jump])
        jump = jump[jump]
        if np.array_equal(new, low):
            # A whole doubling without change: every cycle has seen all of itself.
            break
        low = new
    start = who[low]
    # Break each cycle before its start: the last element points at itself with nothing left.
    last = successor == start
    hop = np.where(last, np.arange(n), successor)
    dist = np.where(last, 0, 1)
    while True:
        new = dist + dist[hop]
        nxt = hop[hop]
        if np.array_equal(nxt, hop):
            break
        dist, hop = new, nxt
    return start, dist[start] - dist


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of the next."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _nested(points: tuple[np.ndarray, np.ndarray], per_ring: np.ndarray, per_polygon: np.ndarray) -> pa.Array:
    xy = pa.StructArray.from_arrays([pa.array(points[0]), pa.array(points[1])], ["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_ring)]).astype(np.int32)), xy)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_polygon)]).astype(np.int32)), rings)


FEATURES = f"raster_id string, region_id long, value double, n_rings int, n_points long, area double, rings {RINGS}"


def polygons_of(raster, region, x0, y0, x1, y1, turn, pos, value, transform: Affine, simplify: bool) -> pa.Table:
    """FEATURES of the regions whose edges these arrays hold, all edges of each."""
    a, b, c, d, e, f = transform
    flip = transform.determinant < 0
    n = len(region)
    names, rid = np.unique(raster.astype(str), return_inverse=True)
    _, place, whose = np.unique(np.stack([rid, region]), axis=1, return_index=True, return_inverse=True)
    whose = whose.reshape(-1)
    wide = int(max(x0.max(), x1.max())) + 2
    tall = int(max(y0.max(), y1.max())) + 2

    def corner(x, y):
        return (whose * tall + y) * wide + x

    begin, end = corner(x0, y0), corner(x1, y1)
    known, at = np.unique(begin, return_inverse=True)
    slot = np.full((len(known), 4), -1, np.int64)
    slot[at, turn] = np.arange(n)
    goal = slot[np.searchsorted(known, end)]
    successor = np.full(n, -1, np.int64)
    for step in (2, 3, 0, 1):  # right turns overrule, then straight on, then left
        found = goal[np.arange(n), (turn + step) % 4]
        successor = np.where(found >= 0, found, successor)
    # A ring starts at its topmost, leftmost edge to the right (exterior) or to the left (hole).
    area2 = x0 * y1 - x1 * y0
    ring0, _ = cycles(successor, np.arange(n))
    _, ring = np.unique(ring0, return_inverse=True)
    twice = np.bincount(ring, area2)
    first_dir = np.where(twice > 0, 0, 2)[ring]
    rank = np.where(turn == first_dir, y0 * wide + np.minimum(x0, x1), np.int64(1) << 60)
    start, step = cycles(successor, rank)
    order = np.lexsort((step, rank[start], (twice <= 0)[ring], whose))
    whose_, ring_, x, y = whose[order], ring[order], x0[order].astype(float), y0[order].astype(float)
    new = np.concatenate([[True], ring_[1:] != ring_[:-1]])
    if simplify:
        turn_ = turn[order]
        firsts = np.flatnonzero(new)
        before = np.arange(n) - 1
        before[firsts] = np.concatenate([firsts[1:], [n]]) - 1
        keep = (turn_ != turn_[before]) | new
        whose_, ring_, x, y, new = whose_[keep], ring_[keep], x[keep], y[keep], new[keep]
    firsts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([firsts, [len(new)]]))
    # Close each ring with its first point.
    take = np.arange(len(new) + len(firsts)) - np.repeat(np.arange(len(firsts)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    take[ends] = firsts
    if flip:
        base = np.repeat(ends - sizes, sizes + 1)
        top = np.repeat(ends, sizes + 1)
        take = take[base + top - np.arange(len(take))]
    col, row = x[take], y[take]
    px, py = a * col + b * row + c, d * col + e * row + f
    per_ring = sizes + 1
    regions = np.diff(np.concatenate([np.flatnonzero(np.concatenate([[True], whose_[firsts][1:] != whose_[firsts][:-1]])), [len(firsts)]]))
    lead = np.lexsort((pos, whose))
    lead = lead[np.concatenate([[True], whose[lead][1:] != whose[lead][:-1]])]
    count = len(place)
    area = np.bincount(whose, area2, count) / 2 * abs(transform.determinant)
    out = pa.table(
        [
            pa.array(names[rid[place]], pa.string()),
            pa.array(region[place]),
            pa.array(value[lead]),
            pa.array(regions.astype(np.int32)),
            pa.array(np.bincount(whose_[firsts], per_ring, count).astype(np.int64)),
            pa.array(area),
            _nested((px, py), per_ring, regions),
        ],
        names=["raster_id", "region_id", "value", "n_rings", "n_points", "area", "rings"],
    )
    return out.filter(pa.array(area >= np.finfo(float).eps)) if n else out


def assemble(edges: DataFrame, transform: Affine = Affine(), simplify: bool = False) -> DataFrame:
    """One row per region: raster_id, region_id, value, n_rings, n_points, area, rings.

    The exterior comes first and starts at its topmost, leftmost corner; holes follow by
    their topmost, leftmost edge. Exteriors are counter-clockwise (area >= 0) after
    ``transform``, holes clockwise. With ``simplify`` points on straight lines are left
    out. Regions whose area vanishes are dropped.
    """
    spark = edges.sparkSession
    ready(spark)
    def run(table):
        raster = table.column("raster_id").to_numpy(zero_copy_only=False)
        region, x0, y0, x1, y1, turn, pos = (table.column(k).to_numpy().astype(np.int64) for k in ("region_id", "x0", "y0", "x1", "y1", "dir", "pos"))
        return polygons_of(raster, region, x0, y0, x1, y1, turn, pos, table.column("value").to_numpy(), transform, simplify)

    groups = max(GROUPS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // PER_GROUP))
    dealt = edges.withColumn("deal", F.pmod(F.xxhash64("raster_id", "region_id"), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(run, FEATURES)
