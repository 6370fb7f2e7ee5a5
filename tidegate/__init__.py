"""A PySpark-native engine for request and event streams."""
