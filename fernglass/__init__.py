"""Spark-native extraction, joining and retrieval over text collections."""
