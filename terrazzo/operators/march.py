"""Marching squares: cells, codes and line segments of every threshold, as DataFrame operations.

Samples stand on pixel numbers. Around the raster lies a frame of -inf, so every line
closes; a cell with a missing corner is skipped. Cells meet only the thresholds between
their smallest and largest corner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import ready

#: Cells of a tile's side.
TILE = 512

#: Fixed: by code (8 top-left, 4 top-right, 2 bottom-right, 1 bottom-left), the edges (T, R, B, L) that a line enters
#: and leaves by, the inside on its left. Codes 5 and 10 depend on the mean of the corners: at or above, then below.
SEGMENTS = {
    1: ["BL"], 2: ["RB"], 3: ["RL"], 4: ["TR"], 6: ["TB"], 7: ["TL"], 8: ["LT"], 9: ["BT"], 11: ["RT"], 12: ["LR"], 13: ["BR"], 14: ["LB"],
    5: (["TL", "BR"], ["TR", "BL"]),
    10: (["LB", "RT"], ["LT", "RB"]),
}

_INF = float("inf")


def framed(pixels: DataFrame, width: int, height: int, tile: int) -> DataFrame:
    """Each sample with the tile of its cells, and on a tile's border with the tiles beside it: raster_id, tile_r, tile_c, row, col, value."""
    r, c = F.col("row"), F.col("col")
    inside = (r >= 0) & (r < height) & (c >= 0) & (c < width)
    to = F.array_distinct(F.array(*[F.struct(F.floor((r + dr) / tile).alias("r"), F.floor((c + dc) / tile).alias("c")) for dr in (0, 1) for dc in (0, 1)]))
    rows = pixels.where(~F.isnan("value") & inside).select("raster_id", "row", "col", "value", F.explode(to).alias("to"))
    return rows.select("raster_id", F.col("to.r").alias("tile_r"), F.col("to.c").alias("tile_c"), "row", "col", "value")


def tile_cells(tile_r: int, tile_c: int, found: pa.Table, width: int, height: int, tile: int) -> list[np.ndarray]:
    """Row and column of a tile's cells with four known corners, and the corners: tl, tr, br, bl."""
    # Cells from one before the tile's first sample on; samples of one row and column more.
    r0, c0 = tile_r * tile - 1, tile_c * tile - 1
    h, w = min(tile, height - r0), min(tile, width - c0)
    grid, known = np.full((h + 1, w + 1), -np.inf), np.zeros((h + 1, w + 1), bool)
    rows, cols = np.arange(r0, r0 + h + 1), np.arange(c0, c0 + w + 1)
    known[(rows < 0) | (rows >= height), :] = known[:, (cols < 0) | (cols >= width)] = True
    y, x = found.column("row").to_numpy() - r0, found.column("col").to_numpy() - c0
    grid[y, x], known[y, x] = found.column("value").to_numpy(), True
    y, x = np.nonzero(known[:-1, :-1] & known[:-1, 1:] & known[1:, 1:] & known[1:, :-1])
    return [y + r0, x + c0, *(grid[y + dr, x + dc] for dr, dc in ((0, 0), (0, 1), (1, 1), (1, 0)))]


def cells(pixels: DataFrame, width: int, height: int, tile: int = TILE) -> DataFrame:
    """One row per cell with four known corners: raster_id, row, col (from -1 on), tl, tr, br, bl. A corner outside the raster is -inf."""
    ready(pixels.sparkSession)

    def run(key, found):
        row, col, *corners = tile_cells(key[1].as_py(), key[2].as_py(), found, width, height, tile)
        return pa.table([pa.array([key[0].as_py()] * len(row), pa.string()), pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), *map(pa.array, corners)], names=["raster_id", "row", "col", "tl", "tr", "br", "bl"])

    return framed(pixels, width, height, tile).groupBy("raster_id", "tile_r", "tile_c").applyInArrow(run, "raster_id string, row int, col int, tl double, tr double, br double, bl double")


def codes(cells_: DataFrame, thresholds: list[float]) -> DataFrame:
    """Each cell with each threshold that crosses it, and its code (1 to 14)."""
    t = F.array(*[F.lit(float(x)) for x in thresholds]) if thresholds else F.array().cast("array<double>")
    low, high = F.least("tl", "tr", "br", "bl"), F.greatest("tl", "tr", "br", "bl")
    out = cells_.select("*", F.explode(F.filter(t, lambda x: (low < x) & (x <= high))).alias("threshold"))
    code = sum((F.when(F.col(k) >= F.col("threshold"), bit).otherwise(0) for k, bit in (("tl", 8), ("tr", 4), ("br", 2), ("bl", 1))), F.lit(0))
    return out.withColumn("code", code)


def fraction(v0: Column, v1: Column, t: Column) -> Column:
    """Where between two corners the threshold lies."""
    inf0, inf1 = F.abs(v0) == _INF, F.abs(v1) == _INF
    near = F.abs(v1 - v0) < 2.220446049250313e-16
    span = F.when(inf0 | inf1 | near, F.lit(1.0)).otherwise(v1 - v0)
    between = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - v0) / span))
    return F.when(inf0 & inf1, 0.5).when(inf0, 0.0).when(inf1, 1.0).when(near, 0.5).otherwise(between)


def segments(codes_: DataFrame) -> DataFrame:
    """Directed segments: raster_id, threshold, row, col, k, x0, y0, x1, y1, and the grid edges that they enter and leave by.

    A grid edge is (0, row, col) between (row, col) and (row, col + 1), (1, row, col)
    between (row, col) and (row + 1, col): a line crosses it at most once.
    """
    r, c, t = F.col("row"), F.col("col"), F.col("threshold")
    mean = (F.col("tl") + F.col("tr") + F.col("br") + F.col("bl")) * 0.25

    def cut(edge: str) -> Column:
        x, y, kind, er, ec = {
            "T": (c + fraction(F.col("tl"), F.col("tr"), t), r.cast("double"), 0, r, c),
            "B": (c + fraction(F.col("bl"), F.col("br"), t), r + F.lit(1.0), 0, r + 1, c),
            "L": (c.cast("double"), r + fraction(F.col("tl"), F.col("bl"), t), 1, r, c),
            "R": (c + F.lit(1.0), r + fraction(F.col("tr"), F.col("br"), t), 1, r, c + 1),
        }[edge]
        return F.struct(x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"), er.alias("er"), ec.alias("ec"))

    cuts = {e: cut(e) for e in "TRBL"}

    def lines(pairs: list[str]) -> Column:
        return F.array(*[F.struct(cuts[p[0]].alias("p"), cuts[p[1]].alias("q")) for p in pairs])

    out = None
    for code, pairs in SEGMENTS.items():
        own = lines(pairs) if isinstance(pairs, list) else F.when(mean >= t, lines(pairs[0])).otherwise(lines(pairs[1]))
        out = F.when(F.col("code") == code, own) if out is None else out.when(F.col("code") == code, own)
    rows = codes_.select("raster_id", "threshold", "row", "col", F.posexplode(out).alias("k", "s"))
    return rows.select(
        "raster_id", "threshold", "row", "col", "k",
        F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"),
        F.struct("s.p.kind", "s.p.er", "s.p.ec").alias("enters"), F.struct("s.q.kind", "s.q.er", "s.q.ec").alias("leaves"),
    )


def _edge_table() -> np.ndarray:
    """By code (16 more for a saddle whose mean is below), k and end: the edge as a place in TRBL, or -1."""
    out = np.full((32, 2, 2), -1)
    for code, pairs in SEGMENTS.items():
        for case, own in ((code, pairs), (code + 16, pairs)) if isinstance(pairs, list) else ((code, pairs[0]), (code + 16, pairs[1])):
            for k, pair in enumerate(own):
                out[case, k] = ["TRBL".index(e) for e in pair]
    return out


_EDGES = _edge_table()


def _fractions(v0: np.ndarray, v1: np.ndarray, t: float) -> np.ndarray:
    """``fraction`` of arrays."""
    inf0, inf1, near = np.isinf(v0), np.isinf(v1), np.zeros(len(v0), bool)
    both = ~(inf0 | inf1)
    near[both] = np.abs(v1[both] - v0[both]) < 2.220446049250313e-16
    out = np.where(inf0 & inf1 | near, 0.5, np.where(inf0, 0.0, 1.0))
    own = both & ~near
    out[own] = np.clip((t - v0[own]) / (v1[own] - v0[own]), 0.0, 1.0)
    return out


def segments_of(row, col, tl, tr, br, bl, t: float) -> tuple[np.ndarray, ...]:
    """The segments of one threshold in cells given as arrays, as ``segments`` has them: row, col, k, x0, y0 and the numbers of the edges that they enter and leave by.

    An edge (kind, row, col) has the number kind + 2 * ((row + 1) * 2**30 + col + 1).
    """
    code = 8 * (tl >= t) + 4 * (tr >= t) + 2 * (br >= t) + 1 * (bl >= t)
    live = np.flatnonzero((code > 0) & (code < 15))
    row, col, tl, tr, br, bl, code = (v[live] for v in (row, col, tl, tr, br, bl, code))
    code = np.where((tl + tr + br + bl) * 0.25 >= t, code, code + 16)
    at, k = np.nonzero(_EDGES[code, :, 0] >= 0)
    enter, leave = _EDGES[code[at], k].T
    row, col, corner = row[at].astype(np.int64), col[at].astype(np.int64), np.stack([tl, tr, br, bl])[:, at]
    # By edge (T, R, B, L): the corners that it lies between, and where it begins.
    place = np.arange(len(at))
    cut = _fractions(corner[np.array([0, 1, 3, 0])[enter], place], corner[np.array([1, 2, 2, 3])[enter], place], t)
    level = enter % 2 == 0
    x0 = col + np.where(level, cut, enter == 1)
    y0 = row + np.where(level, enter == 2, cut)

    def number(edge):
        kind = edge % 2
        return kind + 2 * ((row + (edge == 2) + 1) * (1 << 30) + col + (edge == 1) + 1)

    return row, col, k, x0, y0, number(enter), number(leave)


def quantized(x: Column) -> Column:
    """A coordinate in steps of 1e-10, half away from zero."""
    return F.round(x * 1e10).cast("long")
