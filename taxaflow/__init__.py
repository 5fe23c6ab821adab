"""Spark-native curation of paired biological datasets and evaluation of models on them."""

__version__ = "0.1.0"
