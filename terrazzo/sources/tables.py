"""Rasters that lie in ordinary tables: a key gives row and column, another column the value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import pixels

#: Width of each raster.
ORDERS, PARTS, VECTORS, EVENTS = 128, 16, 64, 50


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _by_key(df: DataFrame, key: str, width: int, value, **more) -> DataFrame:
    return pixels(df, F.floor(F.col(key) / width), F.col(key) % width, value, **more)


def order_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes 1 to 5."""
    return _by_key(read(spark, sf_dir, "orders"), "o_orderkey", ORDERS, F.substring("o_orderpriority", 1, 1).cast("int"))


def part_sizes(spark: SparkSession, sf_dir: str, nodata: float | None = None, mask=None) -> DataFrame:
    """Sizes by tens: classes 0 to 4."""
    value = F.floor((F.col("p_size") - 1) / 10).cast("int")
    return _by_key(read(spark, sf_dir, "part"), "p_partkey", PARTS, value, nodata=nodata, mask=mask)


def vector_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    return pixels(rows, F.col("vec_id"), F.col("k"), F.col("v").cast("double"))


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(read(spark, sf_dir, "events"), "event_id", EVENTS, F.col("value").cast("double"))
