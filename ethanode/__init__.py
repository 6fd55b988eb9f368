"""Spark-native analytics for wearable biosensor recordings."""

__version__ = "0.1.0"
