"""knowloom: a PySpark-native engine for project memories and dependency graphs."""

__version__ = "0.1.0"
