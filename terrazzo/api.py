"""The four array functions: polygons of equal pixels and filled contours, as GeoJSON or as an Arrow table."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .functions.affine import as_affine
from .functions.encode import FIELD_METADATA, GEO_METADATA, geojson, with_wkb
from .plans.isobands import isobands
from .plans.polygonize import polygonize
from .sources.arrays import checked, pixels_of


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _shapes(source, mask, connectivity, transform, nodata) -> DataFrame:
    array, own = checked(source, mask, nodata, connectivity)
    as_affine(transform)
    spark = _session()
    return polygonize(pixels_of(spark, array, own), max(1, array.shape[1]), connectivity, transform).orderBy("region_id")


def _contours(source, thresholds, mask, transform, nodata) -> DataFrame:
    array, own = checked(source, mask, nodata)
    as_affine(transform)
    return isobands(pixels_of(_session(), array, own), array.shape[1], array.shape[0], list(thresholds), transform).orderBy("feature_id")


def _pairs(features: DataFrame) -> list[tuple[dict, float]]:
    found = features.select(geojson(features["rings"]).alias("g"), "value").toArrow().to_pylist()
    return [(json.loads(r["g"]), r["value"]) for r in found]


def _table(features: DataFrame) -> pa.Table:
    found = with_wkb(features.select("rings", "value")).select("geometry", "value").toArrow()
    schema = pa.schema([pa.field("geometry", pa.binary(), False, FIELD_METADATA), pa.field("value", pa.float64(), False)], {"geo": GEO_METADATA})
    return found.cast(schema)


def shapes(source, mask=None, connectivity: int = 4, transform=None, nodata=None) -> list[tuple[dict, float]]:
    """GeoJSON polygons of the regions of equal pixels, with their values."""
    return _pairs(_shapes(source, mask, connectivity, transform, nodata))


def shapes_arrow(source, mask=None, connectivity: int = 4, transform=None, nodata=None) -> pa.Table:
    """The same as an Arrow table (geometry: WKB, value) with GeoParquet metadata."""
    return _table(_shapes(source, mask, connectivity, transform, nodata))


def contours(source, thresholds, mask=None, transform=None, nodata=None) -> list[tuple[dict, float]]:
    """GeoJSON polygons of the bands [lo, hi) between neighbouring thresholds, with lo."""
    return _pairs(_contours(source, thresholds, mask, transform, nodata))


def contours_arrow(source, thresholds, mask=None, transform=None, nodata=None) -> pa.Table:
    """The same as an Arrow table (geometry: WKB, value) with GeoParquet metadata."""
    return _table(_contours(source, thresholds, mask, transform, nodata))
