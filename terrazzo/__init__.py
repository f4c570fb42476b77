"""Raster vectorization and analytics on Spark DataFrames."""
