"""Spark-native analytics for drive telemetry, road graphs, place search and text."""
