"""Spark-native analytics over software-quality evidence."""

__all__ = ["session", "storage", "tables"]
