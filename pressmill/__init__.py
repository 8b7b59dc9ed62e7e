"""Spark-native article search, retrieval evaluation and corpus preparation."""
