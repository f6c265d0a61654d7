"""Spark-first cross-table entity resolution and data processing engine."""

__version__ = "0.1.0"
