"""Spark-native analytics for short-read sequence data and the vectors derived from it."""

__version__ = "0.1.0"
