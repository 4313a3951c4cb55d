"""Spark-native retrieval and analytics engine."""
