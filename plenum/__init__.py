"""Spark-native analytics over public records."""
