"""Spark-native engine for conversational-data preparation, validation, de-duplication and scoring."""

__version__ = "0.1.0"
