"""Spark-native site-content analytics and search."""
