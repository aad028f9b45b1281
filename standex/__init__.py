"""Spark-native retrieval over standards documents: ingest, search, ranking, evaluation."""
