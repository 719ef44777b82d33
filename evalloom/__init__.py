"""Spark-native evaluation and retention analytics."""
