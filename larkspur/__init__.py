"""A PySpark-native engine for entity resolution and bibliometrics."""
