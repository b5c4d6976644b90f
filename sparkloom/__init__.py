"""Spark-native engine for document retrieval, its evaluation and corpus preparation."""

__version__ = "0.1.0"
