"""Spark-native building blocks for spatial-temporal panels."""
