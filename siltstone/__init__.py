"""Spark-native analytics over sandbox reports, extracted strings and text corpora."""
