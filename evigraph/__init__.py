"""Spark-native evidence and knowledge-graph analytics."""
