"""Polygons of equal-valued regions, from a pixel table to features.

A tile's regions that don't reach its border become polygons where they are labelled; of
the others, each tile sends their edges, and those that go on in one another are named
by their first pixel and assembled together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.affine import Affine, as_affine
from ..operators.components import connected_components
from ..operators.label import TILE, framed, label_regions, tile_regions
from ..operators.rings import FEATURES, assemble, polygons_of
from ..staging import ready, stage

#: Of a region that goes on: its edges (begin, direction, pixel), and the pixels by which it does, with the first pixel that each meets (-1: none).
OPEN = "edge_x array<int>, edge_y array<int>, edge_dir array<int>, edge_pos array<long>, border array<long>, meets array<long>"
#: By direction (right, down, left, up): from a pixel's corner to where its edge begins, and on to where it ends.
BEGIN, STEP = np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[1, 0], [0, 1], [-1, 0], [0, -1]])


def _grouped(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    order = np.argsort(owner, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)), pa.array(values[order], kind))


def _tile_polygons(width: int, tile: int, transform: Affine, simplify: bool):
    names = [f.split()[0] for f in FEATURES.split(", ")] + [f.split()[0] for f in OPEN.split(", ")]

    def run(key, found):
        row, col, value, region, sides, onward = tile_regions(key[1].as_py(), key[2].as_py(), found, width, tile, ["e", "s"])
        raster = key[0].as_py()
        pos = row * width + col
        pixel, turn = np.nonzero((sides[:, None] >> np.arange(4)) & 1)
        x0, y0 = col[pixel] + BEGIN[turn, 0], row[pixel] + BEGIN[turn, 1]
        # A pixel on the tile's border without an edge there goes on; so does its region.
        top, left = key[1].as_py() * tile, key[2].as_py() * tile
        out = np.stack([(row == top) & (sides & 1 == 0), (col == left + tile - 1) & (sides & 2 == 0), (row == top + tile - 1) & (sides & 4 == 0), (col == left) & (sides & 8 == 0)])
        going = np.flatnonzero(out.any(axis=0))
        open_ = np.unique(region[going])
        is_open = np.isin(region[pixel], open_)
        k = np.flatnonzero(~is_open)
        done = polygons_of(np.full(len(k), raster), region[pixel[k]], x0[k], y0[k], (x0 + STEP[turn, 0])[k], (y0 + STEP[turn, 1])[k], turn[k], pos[pixel[k]], value[pixel[k]], transform, simplify) if len(k) else None
        parts = []
        if done is not None and len(done):
            parts.append(pa.table([*done.columns, *(pa.nulls(len(done), t) for t in (*(pa.list_(pa.int32()),) * 3, *(pa.list_(pa.int64()),) * 3))], names=names))
        if len(open_):
            n = len(open_)
            k = np.flatnonzero(is_open)
            owner = np.searchsorted(open_, region[pixel[k]])
            # Only to the right and down: each crossing is named once.
            to = np.where(out[1, going], pos[going] + 1, np.where(out[2, going], pos[going] + width, -1))
            corner = np.flatnonzero(out[1, going] & out[2, going])
            border, meets = np.concatenate([pos[going], pos[going][corner]]), np.concatenate([to, pos[going][corner] + width])
            who = np.searchsorted(open_, np.concatenate([region[going], region[going][corner]]))
            first = np.flatnonzero(np.isin(pos, open_))
            first = first[np.argsort(pos[first])]
            lists = [*(_grouped(v[k], owner, n, pa.int32()) for v in (x0, y0, turn)), _grouped(pos[pixel[k]], owner, n, pa.int64()), _grouped(border, who, n, pa.int64()), _grouped(meets, who, n, pa.int64())]
            kinds = (pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
            parts.append(pa.table([pa.array([raster] * n, pa.string()), pa.array(open_), pa.array(value[first]), *(pa.nulls(n, t) for t in kinds), *lists], names=names))
        if not parts:
            empty = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), *(pa.list_(pa.int32()),) * 3, *(pa.list_(pa.int64()),) * 3]
            return pa.table([pa.nulls(0, t) for t in empty], names=names)
        return pa.concat_tables([t.cast(parts[-1].schema) for t in parts])

    return run


def polygons_of_tile(found: pa.Table, width: int, tile: int, transform: Affine) -> pa.Table | None:
    """FEATURES of a tile (row, col, value of its known pixels) that is a raster of its own; ``tile`` is at least its longer side."""
    row, col, value, region, sides, _ = tile_regions(0, 0, found, width, tile, ["e", "s"])
    if not len(row):
        return None
    pixel, turn = np.nonzero((sides[:, None] >> np.arange(4)) & 1)
    x0, y0 = col[pixel] + BEGIN[turn, 0], row[pixel] + BEGIN[turn, 1]
    return polygons_of(np.full(len(pixel), "t"), region[pixel], x0, y0, x0 + STEP[turn, 0], y0 + STEP[turn, 1], turn, (row * width + col)[pixel], value[pixel], transform, False)


def _crossing(parts: DataFrame, transform: Affine, simplify: bool) -> DataFrame:
    """Polygons of the regions that go on over tile borders."""
    links = parts.select("raster_id", "region_id", F.explode(F.arrays_zip("border", "meets")).alias("at")).select("raster_id", "region_id", "at.border", "at.meets")
    other = links.select("raster_id", F.col("border").alias("meets"), F.col("region_id").alias("other")).distinct()
    edges = links.where("meets >= 0").join(other, ["raster_id", "meets"]).select("raster_id", F.col("region_id").alias("one"), F.col("other").alias("two")).distinct()
    # Components want one number for a region: a hash, taken apart again by raster and value below.
    node = F.xxhash64("raster_id", "region_id")
    found = connected_components(edges.select(F.xxhash64("raster_id", "one").alias("u"), F.xxhash64("raster_id", "two").alias("v")))
    named = parts.select("raster_id", "region_id", "value", node.alias("node")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("raster_id", "root").agg(F.min("region_id").alias("whole"))
    names = stage(named.join(least, ["raster_id", "root"]).select("raster_id", "region_id", "whole"), "named")
    at = F.explode(F.arrays_zip("edge_x", "edge_y", "edge_dir", "edge_pos")).alias("e")
    rows = parts.join(names, ["raster_id", "region_id"]).select("raster_id", F.col("whole").alias("region_id"), "value", at)
    dx, dy = (F.element_at(F.array(*[F.lit(int(v)) for v in STEP[:, k]]), F.col("e.edge_dir") + 1) for k in (0, 1))
    rows = rows.select("raster_id", "region_id", F.col("e.edge_x").alias("x0"), F.col("e.edge_y").alias("y0"), (F.col("e.edge_x") + dx).alias("x1"), (F.col("e.edge_y") + dy).alias("y1"), F.col("e.edge_dir").alias("dir"), F.col("e.edge_pos").alias("pos"), "value")
    return assemble(rows, transform, simplify)


def polygonize(pixels: DataFrame, width: int, connectivity: int = 4, transform: object = None, tile: int = TILE, simplify: bool = False) -> DataFrame:
    """One row per 4-connected region: raster_id, region_id, value, n_rings, n_points, area, rings.

    With connectivity 8 the polygons are the same (corners don't join rings), and
    ``group_id`` names the 8-connected region that each belongs to.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    ready(pixels.sparkSession)
    affine = as_affine(transform)
    tiles = framed(pixels, tile).groupBy("raster_id", "tile_r", "tile_c").applyInArrow(_tile_polygons(width, tile, affine, simplify), f"{FEATURES}, {OPEN}")
    tiles = stage(tiles, "tiles")
    features = tiles.where("rings IS NOT NULL").select(*[f.split()[0] for f in FEATURES.split(", ")])
    parts = tiles.where("rings IS NULL")
    if not parts.isEmpty():
        features = features.unionByName(_crossing(parts, affine, simplify))
    if connectivity == 8:
        wider = label_regions(pixels, width, 8, tile).select("raster_id", F.col("pos").alias("region_id"), F.col("region_id").alias("group_id"))
        features = features.join(wider, ["raster_id", "region_id"])
    return features


def class_area(features: DataFrame) -> DataFrame:
    """Area and number of polygons by value."""
    return features.groupBy("value").agg(F.sum("area").alias("area"), F.count("*").alias("n_polygons"))


def class_area_delta(one: DataFrame, two: DataFrame) -> DataFrame:
    """Areas by value of both, aligned (absent: 0), and their absolute difference."""
    left = one.groupBy("value").agg(F.sum("area").alias("area_1"))
    right = two.groupBy("value").agg(F.sum("area").alias("area_2"))
    both = left.join(right, "value", "full_outer").select("value", *(F.coalesce(k, F.lit(0.0)).alias(k) for k in ("area_1", "area_2")))
    return both.withColumn("delta", F.abs(F.col("area_1") - F.col("area_2")))
