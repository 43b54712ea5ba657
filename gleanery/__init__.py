"""A PySpark-native engine for offer intelligence and text analytics."""
