"""SQL functions: register once per session, then use in any query.

    SELECT wkb_polygon(rings) FROM polygons
    SELECT t.id, p.* FROM tiles t, LATERAL polygonize_tile(t.data, t.w, t.r0, t.c0) p
    SELECT t.id, p.* FROM tiles t, LATERAL isobands_tile(t.data, t.w, array(0.5D, 2.0D)) p

The last two take a tile (row by row, null: missing) as a raster of its own; polygons that go on
in other tiles are made by ``polygonize`` and ``isobands``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..staging import ready
from .affine import Affine
from .encode import polygons_wkb


def _samples(data, width: int) -> pa.Table:
    """Known values of a tile with their rows and columns."""
    values = np.array([np.nan if v is None else v for v in data], float)
    at = np.array([k for k, v in enumerate(data) if v is not None], np.int64)
    return pa.table([pa.array(at // width), pa.array(at % width), pa.array(values[at])], names=["row", "col", "value"])


class PolygonizeTile:
    """value, geometry (WKB) of each region of equal neighbouring values."""

    def eval(self, data, w, r0, c0):
        from ..plans.polygonize import polygons_of_tile

        found = polygons_of_tile(_samples(data or [], w), w, max(w, -(-len(data or []) // w)), Affine(1, 0, c0, 0, 1, r0))
        if found is not None and len(found):
            yield from zip(found.column("value").to_pylist(), polygons_wkb(found.column("rings")).to_pylist())


class IsobandsTile:
    """value (the lower threshold), geometry (WKB) of each polygon of the bands between neighbouring thresholds."""

    def eval(self, data, w, thresholds):
        from ..plans.isobands import bands_of_tile

        found = bands_of_tile(_samples(data or [], w), w, -(-len(data or []) // w), thresholds or [])
        if found is not None and len(found):
            yield from zip(found.column("value").to_pylist(), polygons_wkb(found.column("rings")).to_pylist())


def register(spark: SparkSession) -> None:
    """``wkb_polygon(rings)`` in Arrow batches, and the table functions ``polygonize_tile`` and ``isobands_tile``, called once for a tile."""
    ready(spark)

    @F.arrow_udf("binary")
    def wkb_polygon(rings: pa.Array) -> pa.Array:
        return polygons_wkb(rings)

    spark.udf.register("wkb_polygon", wkb_polygon)
    spark.udtf.register("polygonize_tile", F.udtf(PolygonizeTile, returnType="value double, geometry binary"))
    spark.udtf.register("isobands_tile", F.udtf(IsobandsTile, returnType="value double, geometry binary"))
