"""Spark-native collection, enrichment and analysis of short news messages."""
