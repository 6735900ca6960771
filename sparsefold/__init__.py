"""Spark-native analytics over versioned corpora of sparse observation-by-feature matrices."""
