"""A PySpark-native analytics engine for console logs and event streams."""
