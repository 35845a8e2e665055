"""A Spark-native engine for hybrid document search and retrieval analytics."""

__version__ = "0.1.0"
