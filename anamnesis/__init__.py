"""Spark-native analytics over conversation histories and document snapshots."""
