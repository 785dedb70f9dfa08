"""Spark-native catastrophe-risk analytics with an optional training-data subpackage."""
