"""Spark-native analytics over hierarchical hexagon cells."""

__version__ = "0.1.0"
