"""Spark-native analytics over labelled observation x attribute data."""

__version__ = "0.1.0"
