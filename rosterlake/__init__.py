"""Spark-native analytics for performance panels (entity x period x season)."""

__version__ = "0.1.0"
