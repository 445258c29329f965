"""spanforge: a PySpark-native engine for structured-extraction data and evaluation."""
