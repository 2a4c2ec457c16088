"""Spark-native analytics over grouped, ordered point data and text corpora."""
