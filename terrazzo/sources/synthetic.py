"""Generated rasters of any size, the same on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    rows = spark.range(width * height)
    return rows.select("id", F.lit("r").alias("raster_id"), F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def random_classes(spark: SparkSession, width: int, height: int, classes: int = 5, seed: int = 42) -> DataFrame:
    return _grid(spark, width, height).withColumn("value", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(classes)).cast("double")).drop("id")


def random_floats(spark: SparkSession, width: int, height: int, seed: int = 42) -> DataFrame:
    return _grid(spark, width, height).withColumn("value", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 24)) / F.lit(float(1 << 24))).drop("id")


def gaussian_hills(spark: SparkSession, width: int, height: int, hills: tuple = ((0.3, 0.35, 0.12, 900.0), (0.7, 0.6, 0.18, 700.0))) -> DataFrame:
    """A smooth surface: each hill is (x, y, spread) as shares of the size, and a height."""
    x, y = F.col("col") / F.lit(float(width)), F.col("row") / F.lit(float(height))
    value = sum((F.lit(top) * F.exp(-((x - cx) ** 2 + (y - cy) ** 2) / F.lit(2 * s * s)) for cx, cy, s, top in hills), F.lit(0.0))
    return _grid(spark, width, height).withColumn("value", value).drop("id")
