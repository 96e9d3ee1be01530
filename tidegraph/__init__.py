"""Spark-native analytics for coordinated activity in review and event logs."""

__version__ = "0.1.0"
