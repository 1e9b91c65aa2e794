"""A PySpark-native engine for typed data pipelines."""
