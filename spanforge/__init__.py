"""Spark-native analytics over gridded surfaces, candidate spans and training-data corpora."""
