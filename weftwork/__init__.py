"""Spark-native analytics over software-team data."""

__all__ = ["session", "tables"]
