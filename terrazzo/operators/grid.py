"""Pixel tables: (raster_id, row, col, value) rows of valid pixels, and their masks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Value types that a raster may have: unsigned 8, 16 and 32 bits arrive as smallint, int and bigint.
VALUE_TYPES = ("smallint", "int", "bigint", "float", "double", "tinyint")


def valid(value: Column, nodata: float | None = None, mask: Column | None = None) -> Column:
    """Whether a pixel counts: not null, not nodata (NaN as nodata stands for every NaN), and in the mask."""
    out = value.isNotNull()
    if nodata is not None:
        out = out & (~F.isnan(value.cast("double")) if math.isnan(nodata) else ~(value.cast("double") == F.lit(float(nodata))))
    if mask is not None:
        out = out & F.coalesce(mask, F.lit(False))
    return out


def pixels(df: DataFrame, row: Column, col: Column, value: Column, raster_id: Column | None = None, nodata: float | None = None, mask: Column | None = None) -> DataFrame:
    """A pixel table from any table. The condition stands on the source's columns, so it reaches the scan."""
    kind = df.select(value.alias("v")).schema[0].dataType.simpleString()
    if kind not in VALUE_TYPES:
        raise TypeError(f"Unsupported dtype: {kind}")
    rows = df.where(valid(value, nodata, mask))
    return rows.select((raster_id if raster_id is not None else F.lit("r")).alias("raster_id"), row.cast("int").alias("row"), col.cast("int").alias("col"), value.cast("double").alias("value"))


def from_tiles(tiles: DataFrame) -> DataFrame:
    """Pixels of a tile table (raster_id, r0, c0, h, w, data, mask); a null mask counts all."""
    rows = tiles.select("raster_id", "r0", "c0", "w", F.posexplode("data").alias("k", "value"), "mask")
    inside = F.when(F.col("mask").isNull(), True).otherwise(F.coalesce(F.get("mask", F.col("k")), F.lit(False)))
    rows = rows.where(inside & F.col("value").isNotNull())
    return rows.select("raster_id", (F.col("r0") + F.floor(F.col("k") / F.col("w"))).cast("int").alias("row"), (F.col("c0") + F.col("k") % F.col("w")).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def to_tiles(pixels_: DataFrame, tile: int) -> DataFrame:
    """Pixels with the tile that each belongs to; edge tiles are smaller."""
    return pixels_.withColumns({"tile_r": F.floor(F.col("row") / tile).cast("int"), "tile_c": F.floor(F.col("col") / tile).cast("int")})


def digitize(value: Column, breaks: list[float]) -> Column:
    """Number of inner breaks that are not above the value."""
    inner = F.array(*[F.lit(float(b)) for b in breaks[1:-1]]) if len(breaks) > 2 else F.array().cast("array<double>")
    return F.size(F.filter(inner, lambda b: b <= value)).cast("int")


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def quantile_breaks(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """(break_idx, value): exact quantiles of the finite values, ascending and distinct."""
    v = F.col(value).cast("double")
    counted = df.where(F.abs(v) < F.lit(float("inf"))).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # Sorted by ranges: a value's rank is that within its range and the sizes of the ranges before.
    ranges = stage(counted.orderBy("v").withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranges.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    total = parts.agg(F.sum("n")).first()[0] or 0
    places = [share * (total - 1) for share in shares] if total else []
    wanted = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    end = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = ranges.join(F.broadcast(before), "part").select("v", (end - F.col("n")).alias("begin"), end.alias("end"))
    held = F.filter(F.array(*map(F.lit, wanted)).cast("array<bigint>"), lambda k: (k >= F.col("begin")) & (k < F.col("end")))
    at = {r.k: r.v for r in ranked.select("v", F.explode(held).alias("k")).collect()}  # two for each share at most
    found = sorted({at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places})
    return df.sparkSession.createDataFrame(list(enumerate(found)), "break_idx int, value double")


def arithmetic_breaks(df: DataFrame, value: str, step: float) -> DataFrame:
    """(break_idx, value): multiples of ``step`` from the least value up to, not including, the largest."""
    edges = df.where(F.abs(F.col(value)) < F.lit(float("inf"))).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    edges = edges.select(F.ceil(F.col("lo") / step).alias("a"), (F.ceil(F.col("hi") / step) - 1).alias("b")).where("a <= b")
    return edges.select(F.posexplode(F.transform(F.sequence("a", "b"), lambda k: k.cast("double") * step)).alias("break_idx", "value"))


def bands(thresholds: list[float]) -> list[tuple[int, float, float]]:
    """(band_idx, lo, hi) of neighbouring thresholds: finite ones, ascending, each once."""
    t = sorted({float(x) for x in thresholds if math.isfinite(x)})
    return [(k, lo, hi) for k, (lo, hi) in enumerate(zip(t, t[1:]))]


def band_table(thresholds: DataFrame, value: str) -> DataFrame:
    """(band_idx, lo, hi) of the finite values of a column, as ``bands`` has them. Thresholds are few: they are ordered in one task."""
    v = F.col(value).cast("double")
    finite = thresholds.where(F.abs(v) < F.lit(float("inf"))).select((v + F.lit(0.0)).alias("lo")).distinct()
    order = Window.orderBy("lo")
    found = finite.select((F.row_number().over(order) - 1).cast("int").alias("band_idx"), "lo", F.lead("lo").over(order).alias("hi"))
    return found.where("hi IS NOT NULL")


def runs(pixels_: DataFrame) -> DataFrame:
    """Horizontal runs of equal neighbouring values: raster_id, row, col0, col1, value, n_pixels."""
    w = Window.partitionBy("raster_id", "row").orderBy("col")
    before, at = F.lag("value").over(w), F.lag("col").over(w)
    same = (at == F.col("col") - 1) & (before == F.col("value")) & ~F.isnan("value")
    marked = pixels_.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(w))
    return marked.groupBy("raster_id", "row", "run").agg(F.min("col").alias("col0"), F.max("col").alias("col1"), F.min_by("value", "col").alias("value"), F.count("*").alias("n_pixels")).drop("run")
