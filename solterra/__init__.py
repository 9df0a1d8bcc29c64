"""Spark-native analytics for mobility, sunlight exposure and tabular pipelines."""
