"""Spark-native analytics for public online discussion."""
