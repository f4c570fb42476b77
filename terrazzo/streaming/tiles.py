"""Polygons from a stream of tiles: each micro-batch is vectorized and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.encode import with_wkb
from ..operators.grid import from_tiles
from ..plans.polygonize import polygonize


def polygonize_stream(tiles: DataFrame, width: int, output: str, checkpoint: str, connectivity: int = 4, transform: object = None) -> StreamingQuery:
    """Write WKB polygons of each arriving batch of whole rasters as Parquet, by batch number.

    A batch that is run again after a failure overwrites its own folder, so each is
    written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        features = polygonize(from_tiles(batch), width, connectivity, transform)
        with_wkb(features).select("raster_id", "geometry", "value").write.mode("overwrite").parquet(f"{output}/batch={number}")

    return tiles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
