"""Spark-native selective question answering and retrieval analytics."""
