"""Spark-native analytics over code graphs, search, history, memory and telemetry tables."""
