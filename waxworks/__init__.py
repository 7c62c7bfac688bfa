"""Spark-native analytics for catalogue and marketplace data."""
