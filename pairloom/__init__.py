"""Spark-native comparison of data sets."""
