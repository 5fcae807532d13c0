"""Spark-native document and knowledge-graph analytics."""
