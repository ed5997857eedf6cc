"""Spark-native metrics, ordered-index, change-log, version and content analytics."""
