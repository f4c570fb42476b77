"""Geometry encodings: GeoJSON text, features and WKB."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import ready

#: Fixed: GeoArrow field metadata and GeoParquet file metadata of a WKB polygon column.
FIELD_METADATA = {"ARROW:extension:name": "geoarrow.wkb", "ARROW:extension:metadata": "{}"}
GEO_METADATA = json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["Polygon"]}}})


def _geometry(rings: Column) -> Column:
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    return F.struct(F.lit("Polygon").alias("type"), points.alias("coordinates"))


def geojson(rings: Column) -> Column:
    """GeoJSON Polygon text; the first ring is the exterior."""
    return F.to_json(_geometry(rings))


def feature_json(rings: Column, **properties: Column) -> Column:
    """GeoJSON Feature text."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*(v.alias(k) for k, v in properties.items())).alias("properties"), _geometry(rings).alias("geometry")))


def polygons_wkb(rings: pa.ListArray) -> pa.Array:
    """Little-endian WKB of each polygon."""
    rings = rings.combine_chunks() if isinstance(rings, pa.ChunkedArray) else rings
    per_polygon = np.concatenate([[0], np.cumsum(rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    inner = rings.flatten()
    per_ring = inner.value_lengths().to_numpy(zero_copy_only=False)
    points = inner.flatten()
    xy = np.empty((len(points), 2), "<f8")
    xy[:, 0], xy[:, 1] = points.field(0).to_numpy(), points.field(1).to_numpy()
    raw = xy.tobytes()
    ends = 16 * np.cumsum(per_ring)
    counts = per_ring.astype("<u4").tobytes()
    out = []
    for a, b in zip(per_polygon[:-1].tolist(), per_polygon[1:].tolist()):
        parts = [b"\x01\x03\x00\x00\x00", np.uint32(b - a).astype("<u4").tobytes()]
        for k in range(a, b):
            parts += [counts[4 * k : 4 * k + 4], raw[int(ends[k] - 16 * per_ring[k]) : int(ends[k])]]
        out.append(b"".join(parts))
    return pa.array(out, pa.binary())


def with_wkb(features: DataFrame, rings: str = "rings", name: str = "geometry") -> DataFrame:
    """Add the WKB of ``rings`` as a binary column with GeoArrow metadata, batch by batch."""
    ready(features.sparkSession)
    at = features.columns.index(rings)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, polygons_wkb(batch.column(at))], names=[*batch.schema.names, name])

    schema = features.schema.simpleString()[7:-1]
    out = features.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema.fields) + f", {name} binary" if schema else f"{name} binary")
    return out.withMetadata(name, FIELD_METADATA)
