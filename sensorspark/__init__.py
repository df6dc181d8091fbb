"""Spark-native analytics over multi-sensor time series."""
