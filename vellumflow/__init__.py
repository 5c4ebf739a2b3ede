"""Spark-native document retrieval and text-analytics engine."""

__version__ = "0.1.0"
