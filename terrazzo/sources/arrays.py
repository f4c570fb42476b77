"""Rasters from numpy arrays, and the checks that arrays undergo."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed: the value types of a raster array.
DTYPES = ("uint8", "uint16", "uint32", "int16", "int32", "float32", "float64")
CONNECTIVITIES = (4, 8)


def checked(source: object, mask: object = None, nodata: float | None = None, connectivity: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The array and the mask of its valid pixels; raises TypeError or ValueError on bad input."""
    if connectivity not in CONNECTIVITIES:
        raise ValueError("connectivity must be 4 or 8")
    array = np.asarray(source)
    if array.dtype.name not in DTYPES:
        raise TypeError(f"Unsupported dtype: {array.dtype.name}")
    if array.ndim != 2:
        raise TypeError(f"Cannot interpret source as {array.dtype.name}")
    if nodata is None and not array.flags.c_contiguous:
        raise ValueError("source must be C-contiguous")
    own = np.ones(array.shape, bool)
    if mask is not None:
        given = np.asarray(mask)
        if given.dtype.kind != "b" or given.ndim != 2:
            raise TypeError("mask must be a 2D bool array")
        if given.shape != array.shape:
            raise ValueError(f"mask shape {given.shape} does not match source shape {array.shape}")
        own = given.copy()
    if nodata is not None:
        own &= ~np.isnan(array) if isinstance(nodata, (float, np.floating)) and math.isnan(nodata) else array != nodata
    return array, own


def pixels_of(spark: SparkSession, array: np.ndarray, mask: np.ndarray, raster_id: str = "r") -> DataFrame:
    """The valid pixels as a table. Values become doubles, which hold every allowed type exactly."""
    row, col = np.nonzero(mask)
    table = pa.table(
        {
            "raster_id": pa.array([raster_id] * len(row), pa.string()),
            "row": pa.array(row.astype(np.int32)),
            "col": pa.array(col.astype(np.int32)),
            "value": pa.array(array[row, col].astype(np.float64)),
        }
    )
    return spark.createDataFrame(table, "raster_id string, row int, col int, value double")


def tiles_of(spark: SparkSession, array: np.ndarray, mask: np.ndarray | None = None, tile: int = 512, raster_id: str = "r") -> DataFrame:
    """A tile table (raster_id, tile_r, tile_c, r0, c0, h, w, data, mask); edge tiles are smaller."""
    rows = []
    for r0 in range(0, array.shape[0], tile):
        for c0 in range(0, array.shape[1], tile):
            part = array[r0 : r0 + tile, c0 : c0 + tile]
            own = None if mask is None else mask[r0 : r0 + tile, c0 : c0 + tile].reshape(-1).tolist()
            rows.append((raster_id, r0 // tile, c0 // tile, r0, c0, *part.shape, part.reshape(-1).astype(float).tolist(), own))
    return spark.createDataFrame(rows, "raster_id string, tile_r int, tile_c int, r0 int, c0 int, h int, w int, data array<double>, mask array<boolean>")
