"""Spark-native analytics over many hourly time series, and training-data operators."""
