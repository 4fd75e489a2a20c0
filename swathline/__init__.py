"""Spark-native analytics for terrain rasters, sensor coverage and survey missions."""
