"""A PySpark-native engine for content analytics, search, ranking and catalog preparation."""
