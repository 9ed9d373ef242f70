"""Spark-native analytics over embedding tables."""
