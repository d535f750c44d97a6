"""A PySpark-native engine for short-read sequence assembly."""
