"""Filled contours: bands [lo, hi) of a sampled surface.

No task holds a raster. Lines are chained tile by tile, and what goes on across a tile's
border is joined there: chains that meet form components, and only those of one
component come together. Holes find the exterior around them in strips of rows, where
every exterior has all its steps that a hole's first point can see. Only a single
polygon is ever as large as it is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.affine import Affine, as_affine
from ..functions.geometry import RING, RINGS
from ..operators import march
from ..operators.components import connected_components
from ..operators.grid import bands
from ..operators.rings import _nested, cycles, spans
from ..staging import ready, stage

EPS = float(np.finfo(float).eps)
#: Cells of a tile's side, rows of a strip, and points that are put together at a time.
TILE, STRIP, PER_GROUP = 256, 32, 1 << 20
LINE = f"raster_id string, threshold double, ring_id long, area double, ring {RING}"
FEATURES = f"raster_id string, feature_id long, value double, n_rings int, n_points long, area double, rings {RINGS}"
COLUMNS = ["closed", "enters", "leaves", "at", "raster_id", "threshold", "ring_id", "area", "ring"]
CHAIN = f"closed boolean, enters long, leaves long, at long, {LINE}"


def _lists(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return _nested((x, y), sizes, np.ones(len(sizes), int)).flatten()


def _shoelace(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signed area of closed rings laid end to end (their last point is the first)."""
    own = np.repeat(np.arange(len(sizes)), sizes)[:-1]
    inner = np.ones(max(0, len(x) - 1), bool)
    inner[np.cumsum(sizes)[:-1] - 1] = False
    term = (x[:-1] * y[1:] - x[1:] * y[:-1])[inner]
    return np.bincount(own[inner], term, len(sizes)) * 0.5


def _closing(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of rings' points, each followed by its first one again."""
    take = np.arange(int(sizes.sum()) + len(sizes)) - np.repeat(np.arange(len(sizes)), sizes + 1)
    take[np.cumsum(sizes + 1) - 1] = first
    return take


def _chained(raster_id: str, which: np.ndarray, thresholds: np.ndarray, rank: np.ndarray, x0: np.ndarray, y0: np.ndarray, enters: np.ndarray, leaves: np.ndarray) -> pa.Table:
    """The chains of a tile's segments, of every threshold: closed ones are lines, the others go on in another tile."""
    n = len(rank)
    if not n:
        return pa.table([pa.array([], pa.bool_()), *(pa.array([], pa.int64()) for _ in range(3)), pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.int64()), pa.array([], pa.float64()), _lists(x0, y0, np.zeros(0, int))], names=COLUMNS)
    edge, number = np.unique(np.concatenate([enters, leaves]), return_inverse=True)
    into, out = which * len(edge) + number[:n], which * len(edge) + number[n:]
    order = np.argsort(into)
    at = np.minimum(np.searchsorted(into[order], out), n - 1)
    follows = into[order][at] == out
    successor = np.where(follows, order[at], -1)
    before = np.full(n, -1)
    before[successor[follows]] = np.flatnonzero(follows)
    # The first segment of each chain that begins outside the tile, by doubling; its last one is led back to it.
    head = np.where(before < 0, np.arange(n), before)
    for _ in range(n.bit_length()):
        head = head[head]
    begins = before < 0
    successor = np.where(follows, successor, head)
    start, step = cycles(successor, np.where(begins, -1 - rank, rank))
    order = np.lexsort((step, start))
    cuts = np.flatnonzero(step[order] == 0)
    sizes = np.diff(np.append(cuts, n))
    closed = ~begins[start[order[cuts]]]
    least = np.minimum.reduceat(rank[order], cuts)
    place = np.arange(n) - np.repeat(cuts, sizes)
    mine = np.full(len(cuts), 0)
    smallest = np.flatnonzero(rank[order] == np.repeat(least, sizes))
    mine[np.searchsorted(cuts, smallest, "right") - 1] = place[smallest]
    keep = np.flatnonzero(~closed | (sizes >= 3))
    # Points of the chains that stay; closed ones end with their first point.
    more = closed[keep].astype(int)
    length = sizes[keep] + more
    ends = np.cumsum(length)
    take = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length - cuts[keep], length)
    take[(ends - 1)[more > 0]] = cuts[keep][more > 0]
    px, py = x0[order[take]], y0[order[take]]
    area = np.where(closed[keep], _shoelace(px, py, length), 0.0) if len(keep) else np.zeros(0)
    last = order[cuts + sizes - 1]
    return pa.table(
        [
            pa.array(closed[keep]),
            pa.array(enters[order[cuts]][keep]),
            pa.array(leaves[last][keep]),
            pa.array(mine[keep]),
            pa.array([raster_id] * len(keep), pa.string()),
            pa.array(thresholds[which[order[cuts]]][keep]),
            pa.array(least[keep]),
            pa.array(area),
            _lists(px, py, length),
        ],
        names=COLUMNS,
    )


def _joined(key, found):
    """Lines made of chains that go on in one another; what ends anywhere is no line."""
    found = found.combine_chunks()
    raster = found.column("raster_id").to_numpy(zero_copy_only=False).astype(str)
    threshold, ring_id, enters, leaves, at = (found.column(c).to_numpy() for c in ("threshold", "ring_id", "enters", "leaves", "at"))
    n = len(ring_id)
    _, name = np.unique(raster, return_inverse=True)
    _, level = np.unique(threshold, return_inverse=True)
    edge, number = np.unique(np.concatenate([enters, leaves]), return_inverse=True)
    which = (name * (level.max() + 1) + level) * len(edge)
    into, out = which + number[:n], which + number[n:]
    order = np.argsort(into)
    slot = np.minimum(np.searchsorted(into[order], out), n - 1)
    follows = into[order][slot] == out
    successor = np.where(follows, order[slot], -1)
    before = np.full(n, -1)
    before[successor[follows]] = np.flatnonzero(follows)
    live = follows.copy()
    end = np.flatnonzero(~follows)
    while len(end):  # cut off what leads into an open end
        live[end] = False
        end = before[end]
        end = end[end >= 0]
        end = end[live[end]]
    own = np.flatnonzero(live)
    renumbered = np.full(n, -1)
    renumbered[own] = np.arange(len(own))
    start, step = cycles(renumbered[successor[own]], ring_id[own]) if len(own) else (own, own)
    points = found.column("ring").combine_chunks()
    points = points.chunk(0) if isinstance(points, pa.ChunkedArray) else points
    sizes = points.value_lengths().to_numpy().astype(np.int64)
    flat = points.flatten()
    x, y = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    base = np.cumsum(sizes) - sizes
    # Each line begins within its first chain, at its own first segment; what lies before that ends the line.
    line = own[start]
    head = step == 0
    low = np.where(head, at[own], 0)
    of = np.concatenate([line, line[head]])
    turn = np.concatenate([step, np.full(int(head.sum()), n + 1)])
    begin = np.concatenate([base[own] + low, base[own[head]]])
    count = np.concatenate([sizes[own] - low, at[own[head]]])
    order = np.lexsort((turn, of))
    of, begin, count = of[order], begin[order], count[order]
    lines, first = np.unique(of, return_index=True)
    total = np.add.reduceat(count, first) if len(lines) else np.zeros(0, np.int64)
    place = spans(begin, count)
    keep = np.repeat(total >= 3, total)
    lines, total, place = lines[total >= 3], total[total >= 3], place[keep]
    take = _closing(np.cumsum(total) - total, total)
    px, py = x[place][take], y[place][take]
    area = _shoelace(px, py, total + 1) if len(lines) else np.zeros(0)
    return pa.table([pa.array(raster[lines], pa.string()), pa.array(threshold[lines]), pa.array(ring_id[lines]), pa.array(area), _lists(px, py, total + 1)], names=["raster_id", "threshold", "ring_id", "area", "ring"])


def isolines(pixels: DataFrame, width: int, height: int, thresholds: list[float], tile: int = TILE) -> DataFrame:
    """Closed lines of each threshold: raster_id, threshold, ring_id, area (signed), ring. Open ones are dropped.

    A segment is followed by the one that enters by the grid edge it leaves by, so the
    segments of a line form a cycle; ring_id names its first cell in row-major order.
    """
    ready(pixels.sparkSession)
    levels = np.array(sorted(set(thresholds)), float)

    def run(key, found):
        cells = march.tile_cells(key[1].as_py(), key[2].as_py(), found, width, height, tile)
        own = [march.segments_of(*cells, t) for t in levels.tolist()]
        row, col, k, x0, y0, enters, leaves = (np.concatenate(v) for v in zip(*own))
        which = np.repeat(np.arange(len(levels)), [len(v[0]) for v in own])
        return _chained(key[0].as_py(), which, levels, ((row + 1) * (width + 2) + col + 1) * 2 + k, x0, y0, enters, leaves)

    rows = march.framed(pixels, width, height, tile).where(F.lit(len(levels) > 0))
    chains = stage(rows.groupBy("raster_id", "tile_r", "tile_c").applyInArrow(run, CHAIN), "chains")
    lines = chains.where("closed").select(*COLUMNS[4:])
    # Chains of one line come together by the components of what they go on in. Two components with one hash only share a task.
    open_ = chains.where("NOT closed")
    if open_.isEmpty():
        return lines
    node = F.xxhash64("raster_id", "threshold", "enters")
    edges = open_.select("raster_id", "threshold", node.alias("u"), F.col("leaves").alias("meets"))
    edges = edges.join(open_.select("raster_id", "threshold", F.col("enters").alias("meets"), node.alias("v")), ["raster_id", "threshold", "meets"]).select("u", "v")
    edges = stage(edges, "meetings")
    if edges.isEmpty():
        return lines
    roots = connected_components(edges)
    total = open_.agg(F.sum(F.size("ring"))).first()[0]
    groups = max(_partitions(open_), math.ceil(total / PER_GROUP))
    dealt = open_.withColumn("node", node).join(roots, "node", "left").withColumn("deal", F.pmod(F.coalesce("root", "node"), F.lit(groups)))
    return lines.unionByName(dealt.groupBy("deal").applyInArrow(_joined, LINE))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _steps_by_strip(batches):
    """Of each exterior and strip of rows, its steps that aren't level."""
    names = ["raster_id", "band_idx", "strip", "key", "size", "x0", "y0", "x1", "y1"]
    for batch in batches:
        rings = batch.column(4)
        sizes = rings.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rings.flatten()
        x, y = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        inner = np.ones(len(x), bool)
        inner[np.cumsum(sizes) - 1] = False
        inner = np.flatnonzero(inner)
        own = np.repeat(np.arange(len(sizes)), sizes)[inner]
        x0, y0, x1, y1 = x[inner], y[inner], x[inner + 1], y[inner + 1]
        strip = np.floor(np.minimum(y0, y1) / STRIP).astype(np.int64)
        keep = np.flatnonzero(y0 != y1)
        order = keep[np.lexsort((strip[keep], own[keep]))]
        own, strip = own[order], strip[order]
        first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (strip[1:] != strip[:-1]))) if len(order) else order
        cuts = pa.array(np.append(first, len(order)).astype(np.int32))
        head = [batch.column(k).take(pa.array(own[first])) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*head[:2], pa.array(strip[first]), *head[2:], *(pa.ListArray.from_arrays(cuts, pa.array(v[order])) for v in (x0, y0, x1, y1))], names=names)


def _around(strict: bool):
    """Of each hole in a strip, the exterior around its first point: the first one or, with ``strict``, the smallest that is larger than the hole."""

    def run(key, exteriors, holes):
        names = ["raster_id", "band_idx", "key", "exterior"]
        lists = exteriors.column("x0").combine_chunks()
        per = (lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists).value_lengths().to_numpy(zero_copy_only=False) if len(exteriors) else np.zeros(0, int)
        x0, y0, x1, y1 = (np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in exteriors.column(k).chunks)]) for k in ("x0", "y0", "x1", "y1"))
        name, size = exteriors.column("key").to_numpy(), exteriors.column("size").to_numpy()
        # Exteriors by turn: a step's number is the turn of its exterior.
        turn = np.lexsort((name, size)) if strict else np.argsort(name)
        position = np.empty(len(turn), np.int64)
        position[turn] = np.arange(len(turn))
        own = np.repeat(position, per)
        name, size = name[turn], size[turn]
        cell = np.floor(np.minimum(y0, y1)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, own, x0, y0, x1, y1 = (v[order] for v in (cell, own, x0, y0, x1, y1))
        hole, hole_size, px, py = (holes.column(k).to_numpy() for k in ("key", "size", "px", "py"))
        lo, hi = np.searchsorted(cell, np.floor(py), "left"), np.searchsorted(cell, np.floor(py), "right")
        chosen = np.full(len(hole), -1)
        a = 0
        while a < len(hole):
            b = max(a + 1, int(np.searchsorted(np.cumsum((hi - lo)[a:]), 1 << 20)) + a)
            h = np.repeat(np.arange(a, b), (hi - lo)[a:b])
            s = spans(lo[a:b], (hi - lo)[a:b])
            up = (y0[s] > py[h]) != (y1[s] > py[h])
            h, s = h[up], s[up]
            right = px[h] < (x1[s] - x0[s]) * (py[h] - y0[s]) / (y1[s] - y0[s]) + x0[s]
            h, s = h[right], s[right]
            pair, times = np.unique(h * (len(name) + 1) + own[s], return_counts=True)
            h, e = np.divmod(pair[times % 2 == 1], len(name) + 1)
            if strict:
                larger = size[e] > hole_size[h]
                h, e = h[larger], e[larger]
            h, first = np.unique(h, return_index=True)
            chosen[h] = e[first]
            a = b
        keep = np.flatnonzero(chosen >= 0)
        return pa.table([pa.array([key[0].as_py()] * len(keep), pa.string()), pa.array(np.full(len(keep), key[1].as_py()), pa.int32()), pa.array(hole[keep]), pa.array(name[chosen[keep]])], names=names)

    return run


def _polygons(affine: Affine):
    """Polygons of exteriors (``key`` is ``exterior``) and their holes."""
    a, b, c, d, e, f = affine
    scale = abs(affine.determinant)

    def run(key, found):
        found = found.combine_chunks()
        raster = found.column("raster_id").to_numpy(zero_copy_only=False).astype(str)
        band, name, exterior, area, lo = (found.column(k).to_numpy() for k in ("band_idx", "key", "exterior", "area", "lo"))
        order = np.lexsort((name, name != exterior, exterior, band, raster))
        raster, band, name, exterior, area, lo = (v[order] for v in (raster, band, name, exterior, area, lo))
        first = np.flatnonzero(name == exterior)
        per = np.diff(np.append(first, len(order)))
        net = np.abs(area[first]) * scale - (np.add.reduceat(np.abs(area) * scale, first) - np.abs(area[first]) * scale)
        keep = net > EPS
        own = np.repeat(keep, per)
        rings = found.column("ring").take(pa.array(order[own])).combine_chunks()
        rings = rings.chunk(0) if isinstance(rings, pa.ChunkedArray) else rings
        sizes = rings.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = rings.flatten()
        # Exteriors run counter-clockwise after the transform, holes clockwise.
        hole = (name != exterior)[own]
        back = np.repeat((area[own] * affine.determinant < 0) != hole, sizes)
        ends = np.cumsum(sizes)
        place = np.arange(len(flat))
        take = np.where(back, np.repeat(2 * ends - sizes - 1, sizes) - place, place)
        col, row = flat.field(0).to_numpy()[take], flat.field(1).to_numpy()[take]
        first, per = first[keep], per[keep]
        return pa.table(
            [
                pa.array(raster[first], pa.string()),
                pa.array((band[first].astype(np.int64) << 48) + exterior[first]),
                pa.array(lo[first]),
                pa.array(per.astype(np.int32)),
                pa.array(np.add.reduceat(sizes, np.cumsum(per) - per) if len(per) else per, pa.int64()),
                pa.array(net[keep]),
                _nested((a * col + b * row + c, d * col + e * row + f), sizes, per),
            ],
            names=["raster_id", "feature_id", "value", "n_rings", "n_points", "area", "rings"],
        )

    return run


def bands_of_tile(found: pa.Table, width: int, height: int, thresholds: list[float]) -> pa.Table | None:
    """Polygons of a tile (row, col, value of its known samples) that is a raster of its own, with the functions that ``isobands`` runs on many tasks."""
    pairs = bands(thresholds) if min(width, height) >= 2 else []
    if not pairs or not len(found):
        return None
    levels = np.array(sorted({t for _, lo, hi in pairs for t in (lo, hi)}))
    found = found.filter(pa.compute.invert(pa.compute.is_nan(found.column("value"))))
    cells = march.tile_cells(0, 0, found, width, height, max(width, height) + 1)
    own = [march.segments_of(*cells, t) for t in levels.tolist()]
    row, col, k, x0, y0, enters, leaves = (np.concatenate(v) for v in zip(*own))
    which = np.repeat(np.arange(len(levels)), [len(v[0]) for v in own])
    lines = _chained("t", which, levels, ((row + 1) * (width + 2) + col + 1) * 2 + k, x0, y0, enters, leaves)
    lines = lines.filter(lines.column("closed")).combine_chunks()
    out = []
    for band, lo, hi in pairs:
        level, area = lines.column("threshold").to_numpy(), lines.column("area").to_numpy()
        big = np.abs(area) >= EPS
        outer = np.flatnonzero((level == lo) & (area < 0) & big)
        hole = np.flatnonzero(((level == lo) & (area >= 0) | (level == hi) & (area < 0)) & big)
        key = 2 * lines.column("ring_id").to_numpy() + (level == hi)
        if not len(outer):
            continue
        owner = np.full(len(hole), key[outer[0]] if len(outer) == 1 else -1)
        if len(outer) > 1 and len(hole):
            rings = lines.column("ring").take(pa.array(outer)).combine_chunks()
            batch = pa.RecordBatch.from_arrays([pa.array(["t"] * len(outer)), pa.array(np.full(len(outer), band), pa.int32()), pa.array(key[outer]), pa.array(np.abs(area[outer])), rings], ["raster_id", "band_idx", "key", "size", "ring"])
            start = [r[0] for r in lines.column("ring").take(pa.array(hole)).to_pylist()]
            points = pa.table({"key": key[hole], "size": np.abs(area[hole]), "px": [p["x"] for p in start], "py": [p["y"] for p in start]})
            # All strips at once: an exterior's steps are one row again.
            steps = pa.Table.from_batches(list(_steps_by_strip([batch])))
            for strip in np.unique(steps.column("strip").to_numpy()).tolist():
                inside = np.floor(points.column("py").to_numpy() / STRIP) == strip
                chosen = _around(False)((pa.scalar("t"), pa.scalar(band)), steps.filter(pa.compute.equal(steps.column("strip"), strip)), points.filter(pa.array(inside)))
                for h, e in zip(chosen.column("key").to_pylist(), chosen.column("exterior").to_pylist()):
                    owner[key[hole] == h] = e
        at = np.concatenate([outer, hole[owner >= 0]])
        exterior = np.concatenate([key[outer], owner[owner >= 0]])
        parts = pa.table([pa.array(["t"] * len(at)), pa.array(np.full(len(at), band)), pa.array(np.full(len(at), lo)), pa.array(key[at]), pa.array(exterior), pa.array(area[at]), lines.column("ring").take(pa.array(at))], names=["raster_id", "band_idx", "lo", "key", "exterior", "area", "ring"])
        out.append(_polygons(as_affine(None))(None, parts))
    return pa.concat_tables(out) if out else None


def isobands(pixels: DataFrame, width: int, height: int, thresholds: list[float], transform: object = None, strict: bool = False, tile: int = TILE) -> DataFrame:
    """One row per polygon of a band: raster_id, feature_id, value (the lower threshold), n_rings, n_points, area, rings.

    ``pixels`` holds the valid samples. A raster or a list of thresholds with fewer than
    two in any direction has no bands. A line that touches a missing cell is left out
    whole. By default holes of the upper line are not filled again; with ``strict`` they
    are bands of their own and holes go to the smallest exterior around them. feature_id
    grows with the band and the first cell of the exterior in row-major order.
    """
    spark = pixels.sparkSession
    ready(spark)
    affine = as_affine(transform)
    pairs = bands(thresholds) if min(width, height) >= 2 else []
    values = sorted({t for _, lo, hi in pairs for t in (lo, hi)})
    if not pairs:
        return spark.createDataFrame([], FEATURES)
    lines = isolines(pixels, width, height, values, tile)
    lines = stage(lines.where(F.abs(F.col("area") * affine.determinant) >= EPS), "isolines")  # each serves two bands
    sides = [F.struct(F.lit(band).alias("band_idx"), F.lit(lo).alias("lo"), F.lit(edge).alias("edge"), F.lit(upper).cast("long").alias("upper")) for band, lo, hi in pairs for upper, edge in enumerate((lo, hi))]
    rings = lines.select("raster_id", "ring_id", "area", "ring", F.explode(F.filter(F.array(*sides), lambda s: s["edge"] == F.col("threshold"))).alias("side"))
    # With y downwards the inside lies on the left of a line: exteriors have negative areas.
    hole = ((F.col("side.upper") == 1) == (F.col("area") < 0)).alias("hole")
    rings = rings.select("raster_id", "side.band_idx", "side.lo", (2 * F.col("ring_id") + F.col("side.upper")).alias("key"), hole, F.col("side.upper").alias("upper"), "area", "ring")
    rings = rings if strict else rings.where("hole OR upper = 0")
    size = F.abs(F.col("area")).alias("size")
    outer, holes = rings.where("NOT hole"), rings.where("hole")
    start = F.element_at("ring", 1)
    points = holes.select("raster_id", "band_idx", F.floor(start["y"] / STRIP).alias("strip"), "key", size, start["x"].alias("px"), start["y"].alias("py"))
    steps = outer.select("raster_id", "band_idx", "key", size, "ring").mapInArrow(_steps_by_strip, "raster_id string, band_idx int, strip long, key long, size double, x0 array<double>, y0 array<double>, x1 array<double>, y1 array<double>")
    by = ["raster_id", "band_idx", "strip"]
    found = steps.groupBy(*by).cogroup(points.groupBy(*by)).applyInArrow(_around(strict), "raster_id string, band_idx int, key long, exterior long")
    if not strict:  # a band's only exterior takes all holes
        alone = outer.groupBy("raster_id", "band_idx").agg(F.min("key").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
        found = holes.select("raster_id", "band_idx", "key").join(found, ["raster_id", "band_idx", "key"], "left").join(alone, ["raster_id", "band_idx"], "left")
        found = found.select("raster_id", "band_idx", "key", F.coalesce("only", "exterior").alias("exterior")).where("exterior IS NOT NULL")
    placed = holes.join(found, ["raster_id", "band_idx", "key"]).select("raster_id", "band_idx", "lo", "key", "exterior", "area", "ring")
    parts = outer.select("raster_id", "band_idx", "lo", "key", F.col("key").alias("exterior"), "area", "ring").unionByName(placed)
    total = lines.agg(F.sum(F.size("ring"))).first()[0] or 0
    groups = max(_partitions(lines), math.ceil(2 * total / PER_GROUP))
    dealt = parts.withColumn("deal", F.pmod(F.xxhash64("raster_id", "band_idx", "exterior"), F.lit(groups)))
    return dealt.groupBy("deal").applyInArrow(_polygons(affine), FEATURES)
