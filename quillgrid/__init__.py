"""Spark-native layout, raster and text analytics."""
