"""Spark-native book analytics, hybrid retrieval and training-data operators."""

__version__ = "0.1.0"
