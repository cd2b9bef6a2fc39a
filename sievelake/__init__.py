"""Spark-native analytics for collected records and training corpora."""
