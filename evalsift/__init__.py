"""Spark-native audit of evaluation data against training corpora."""
