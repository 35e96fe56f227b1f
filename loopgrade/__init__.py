"""Spark-native analytics for material-reuse marketplaces and the data behind their models."""

__version__ = "0.1.0"
