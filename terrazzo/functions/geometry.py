"""Functions of rings (arrays of x, y points), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
RINGS = f"array<{RING}>"


def _steps(ring: Column) -> Column:
    """Neighbouring points of a closed ring: struct(p, q)."""
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, summed from its start; 0 for fewer than three points."""
    total = F.aggregate(_steps(ring), F.lit(0.0), lambda s, k: s + (k["p"]["x"] * k["q"]["y"] - k["q"]["x"] * k["p"]["y"]))
    return F.when(F.size(ring) >= 3, total * 0.5).otherwise(F.lit(0.0))


def net_area(rings: Column) -> Column:
    """Area of a polygon: the first ring's without the others'."""
    areas = F.transform(rings, lambda r: F.abs(signed_area(r)))
    return F.aggregate(areas, F.lit(0.0), lambda s, a: s - a, lambda s: s + 2 * F.element_at(areas, 1))


def bounds(ring: Column) -> Column:
    x, y = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("min_x"), F.array_max(x).alias("max_x"), F.array_min(y).alias("min_y"), F.array_max(y).alias("max_y"))


def in_bounds(x: Column, y: Column, box: Column) -> Column:
    return (x >= box["min_x"]) & (x <= box["max_x"]) & (y >= box["min_y"]) & (y <= box["max_y"])


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test, half open in y; false for fewer than three points."""

    def crosses(k: Column) -> Column:
        p, q = k["p"], k["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(spans, q["y"] - p["y"]).otherwise(F.lit(1.0)) + p["x"]
        return spans & (x < at)

    inside = F.aggregate(_steps(ring), F.lit(False), lambda s, k: s != crosses(k))
    return F.when(F.size(ring) >= 3, inside).otherwise(F.lit(False))


def normalized(rings: Column) -> Column:
    """The first ring counter-clockwise (area >= 0), the others clockwise."""

    def turned(r: Column, i: Column) -> Column:
        area = signed_area(r)
        return F.when(((i == 0) & (area < 0)) | ((i > 0) & (area > 0)), F.reverse(r)).otherwise(r)

    return F.transform(rings, turned)


def n_points(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0).cast("long"), lambda s, r: s + F.size(r))


def wkb_size(rings: Column) -> Column:
    return F.lit(9).cast("long") + 4 * F.size(rings) + 16 * n_points(rings)
