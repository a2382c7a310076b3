"""PySpark-native engine for repeated-count wildlife survey data."""

__version__ = "0.1.0"
