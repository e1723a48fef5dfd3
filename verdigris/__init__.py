"""Spark-native analytics for retrieval, evidence and answer-governance logs."""
