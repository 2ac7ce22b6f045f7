"""Lodestone: a Spark-native engine that orders, stores, queries and measures point tables."""
