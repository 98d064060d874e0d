"""Spark-native inventory engine for source trees, manifests and documents."""
