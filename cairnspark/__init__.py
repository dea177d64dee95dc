"""Spark-native content deduplication, archive and run analytics."""
