"""Spark-native analytics over correspondence tables (points, tiles, grids, rays)."""
