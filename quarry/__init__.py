"""A PySpark-native search and analytics engine for log and text data."""
