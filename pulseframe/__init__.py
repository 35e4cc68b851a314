"""PySpark-native analytics for personal health and training data."""
