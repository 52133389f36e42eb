"""Spark-native analytics over replicated document outputs and feature-by-sample matrices."""
