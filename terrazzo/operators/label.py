"""Region labelling: connected components of equal neighbouring pixels.

Each tile is labelled on its own together with a frame of one pixel around it, so that
one pass gives local labels, which sides of each pixel are boundaries, and which pixels
go on across a tile border. Only the border pixels form a graph, whose components give
the final ids: a region is named by its first pixel in row-major order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import ready, stage
from .components import connected_components, forest
from .grid import to_tiles

TILE = 512
#: Sides of a pixel as bits: heading right along its top, down its right, left along its bottom, up its left.
TOP, RIGHT, BOTTOM, LEFT = 1, 2, 4, 8
_STEPS = {"e": (0, 1), "s": (1, 0), "se": (1, 1), "sw": (1, -1)}


def framed(pixels: DataFrame, tile: int) -> DataFrame:
    """Each pixel in its tile, and border pixels also in the frames of the tiles beside it."""
    r, c = F.col("row"), F.col("col")
    up, down = F.pmod(r, F.lit(tile)) == 0, F.pmod(r, F.lit(tile)) == tile - 1
    left, right = F.pmod(c, F.lit(tile)) == 0, F.pmod(c, F.lit(tile)) == tile - 1
    steps = [F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    fits = {-1: up, 0: F.lit(True), 1: down}, {-1: left, 0: F.lit(True), 1: right}
    chosen = [F.when(fits[0][dr] & fits[1][dc], s) for (dr, dc), s in zip([(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)], steps)]
    rows = to_tiles(pixels, tile)
    edge = up | down | left | right
    to = F.when(edge, F.filter(F.array(*chosen), lambda s: s.isNotNull())).otherwise(F.array(steps[4]))
    rows = rows.select("raster_id", "row", "col", "value", "tile_r", "tile_c", F.explode(to).alias("to"))
    return rows.select("raster_id", (F.col("tile_r") + F.col("to.dr")).alias("tile_r"), (F.col("tile_c") + F.col("to.dc")).alias("tile_c"), "row", "col", "value")


def _label(same: dict[str, np.ndarray], inside: np.ndarray, steps: list[str]) -> np.ndarray:
    """Smallest flat index of each component within the tile (without its frame)."""
    h, w = inside.shape
    index = np.arange(h * w).reshape(h, w)
    # Runs first: only their heads enter the graph.
    joined = np.zeros((h, w), bool)
    joined[:, 1:] = same["e"][:, :-1] & inside[:, 1:] & inside[:, :-1]
    head = np.where(joined, 0, index)
    head = np.maximum.accumulate(head.reshape(-1)).reshape(h, w)
    pairs = []
    for name in steps:
        if name == "e":
            continue
        dr, dc = _STEPS[name]
        a = index[: h - dr, max(0, -dc) : w - max(0, dc)]
        ok = same[name][: h - dr, max(0, -dc) : w - max(0, dc)] & inside[: h - dr, max(0, -dc) : w - max(0, dc)]
        a = a[ok]
        b = a + dr * w + dc
        good = inside.reshape(-1)[b]
        pairs.append(np.stack([head.reshape(-1)[a[good]], head.reshape(-1)[b[good]]]))
    label = head.reshape(-1)
    if pairs:
        a, b = np.concatenate(pairs, axis=1)
        if len(a):
            key = np.unique(a * (h * w) + b)
            node, root = forest(key // (h * w), key % (h * w))
            to = np.arange(h * w)
            to[node] = root
            label = to[label]
    return label.reshape(h, w)


def tile_regions(tr: int, tc: int, found: pa.Table, width: int, tile: int, steps: list[str]) -> tuple[np.ndarray, ...]:
    """Of each pixel of a tile: row, col, value, region (named by its first pixel in the tile), sides and onward (bits)."""
    row, col, value = (found.column(c).to_numpy() for c in ("row", "col", "value"))
    r0, c0 = tr * tile, tc * tile
    own = (row >= r0) & (row < r0 + tile) & (col >= c0) & (col < c0 + tile)
    if not own.any():
        row = row[:0]
    # The smallest rectangle around the tile's own pixels, and a frame.
    lo_r, hi_r = (int(row[own].min()), int(row[own].max())) if len(row) else (0, -1)
    lo_c, hi_c = (int(col[own].min()), int(col[own].max())) if len(row) else (0, -1)
    h, w = hi_r - lo_r + 3, hi_c - lo_c + 3
    grid, there = np.full((h, w), np.nan), np.zeros((h, w), bool)
    if len(row):
        y, x = row - lo_r + 1, col - lo_c + 1
        near = (y >= 0) & (y < h) & (x >= 0) & (x < w)
        y, x = y[near], x[near]
        grid[y, x], there[y, x] = value[near], True
        if there.sum() != len(y):
            raise ValueError("two pixels of a raster have the same row and col")
    inside = np.zeros((h, w), bool)
    inside[1:-1, 1:-1] = there[1:-1, 1:-1]
    same = {}
    for name, (dr, dc) in _STEPS.items():
        out = np.zeros((h, w), bool)
        a = (slice(0, h - dr), slice(max(0, -dc), w - max(0, dc)))
        b = (slice(dr, h), slice(max(0, dc), w - max(0, -dc)))
        out[a] = (grid[a] == grid[b]) & there[a] & there[b]
        same[name] = out
    label = _label(same, inside, steps)
    y, x = np.nonzero(inside)
    sides = np.where(same["s"][y - 1, x], 0, TOP) | np.where(same["e"][y, x], 0, RIGHT) | np.where(same["s"][y, x], 0, BOTTOM) | np.where(same["e"][y, x - 1], 0, LEFT)
    onward = np.zeros(len(y), np.int64)
    for k, name in enumerate(steps):
        dr, dc = _STEPS[name]
        onward |= np.where(same[name][y, x] & ~inside[y + dr, x + dc], 1 << k, 0)
    first = label[y, x]
    row, col = y + lo_r - 1, x + lo_c - 1
    region = (first // w + lo_r - 1) * width + (first % w + lo_c - 1)
    return row, col, grid[y, x], region, sides, onward


def local_regions(pixels: DataFrame, width: int, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """One row per pixel: raster_id, row, col, value, pos, region (in its tile), sides (bits), onward (bits across tile borders)."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    ready(pixels.sparkSession)
    steps = ["e", "s"] if connectivity == 4 else ["e", "s", "se", "sw"]

    def run(key, found):
        row, col, value, region, sides, onward = tile_regions(key[1].as_py(), key[2].as_py(), found, width, tile, steps)
        n = len(row)
        return pa.table(
            [pa.array([key[0].as_py()] * n, pa.string()), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(value), pa.array(row * width + col), pa.array(region), pa.array(sides.astype(np.int32)), pa.array(onward.astype(np.int32))],
            names=["raster_id", "row", "col", "value", "pos", "region", "sides", "onward"],
        )

    return framed(pixels, tile).groupBy("raster_id", "tile_r", "tile_c").applyInArrow(run, "raster_id string, row int, col int, value double, pos long, region long, sides int, onward int")


def label_regions(pixels: DataFrame, width: int, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """One row per pixel: raster_id, row, col, value, pos, region_id, sides.

    region_id is the smallest ``row * width + col`` of the region. NaN equals nothing,
    so each NaN pixel is a region; 0.0 and -0.0 are equal.
    """
    local = stage(local_regions(pixels, width, connectivity, tile), "local")
    steps = [width, 1][::-1] if connectivity == 4 else [1, width, width + 1, width - 1]
    cross = F.filter(F.array(*[F.when(F.col("onward").bitwiseAND(1 << k) != 0, F.lit(d)) for k, d in enumerate(steps)]), lambda d: d.isNotNull())
    going = local.where("onward <> 0").select("raster_id", "region", "pos", F.explode(cross).alias("step")).select("raster_id", F.col("region").alias("one"), (F.col("pos") + F.col("step")).alias("pos"))
    edges = going.join(local.select("raster_id", "pos", F.col("region").alias("two")), ["raster_id", "pos"]).select("raster_id", "one", "two").where("one <> two").distinct()
    edges = stage(edges, "crossings")
    if edges.isEmpty():
        return local.select("raster_id", "row", "col", "value", "pos", F.col("region").alias("region_id"), "sides")
    # Components want one number: regions that cross a border are numbered by raster.
    node = F.xxhash64("raster_id", "region")
    names = edges.select("raster_id", F.col("one").alias("region")).union(edges.select("raster_id", F.col("two").alias("region"))).distinct().withColumn("node", node)
    found = connected_components(edges.select(F.xxhash64("raster_id", "one").alias("u"), F.xxhash64("raster_id", "two").alias("v")))
    grouped = names.join(found, "node", "left").select("raster_id", "region", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("raster_id", "root").agg(F.min("region").alias("region_id"))
    final = stage(grouped.join(least, ["raster_id", "root"]).select("raster_id", "region", "region_id"), "merged")
    out = local.join(final, ["raster_id", "region"], "left")
    return out.select("raster_id", "row", "col", "value", "pos", F.coalesce("region_id", "region").alias("region_id"), "sides")


def region_stats(labels: DataFrame) -> DataFrame:
    """Per region, without any geometry: value, n_pixels, first_row, first_col, perimeter (sides)."""
    return labels.groupBy("raster_id", "region_id").agg(
        F.min_by("value", "pos").alias("value"),
        F.count("*").alias("n_pixels"),
        F.min("row").alias("first_row"),
        F.min_by("col", "pos").alias("first_col"),
        F.sum(F.bit_count("sides")).alias("perimeter"),
    )


def region_holes(labels: DataFrame) -> DataFrame:
    """Number of holes per 4-connected region from its 2 x 2 windows (Gray 1971): holes = 1 - Euler number."""
    at = F.explode(F.array(*[F.struct((F.col("row") + dr).alias("y"), (F.col("col") + dc).alias("x"), F.lit(bit).alias("bit")) for dr, dc, bit in ((0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8))]))
    quads = labels.select("raster_id", "region_id", at.alias("q")).groupBy("raster_id", "region_id", "q.y", "q.x").agg(F.sum("q.bit").alias("code"))
    one, three, diagonal = (F.count_if(F.col("code").isin(*codes)) for codes in ((1, 2, 4, 8), (7, 11, 13, 14), (6, 9)))
    return quads.groupBy("raster_id", "region_id").agg((1 - (one - three + 2 * diagonal) / 4).cast("long").alias("n_holes"))
