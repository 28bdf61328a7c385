"""Spark-native analytics for multilingual news monitoring."""
