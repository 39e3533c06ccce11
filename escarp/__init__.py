"""A PySpark-native engine for road-climb analytics."""
