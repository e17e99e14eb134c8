"""weir: a PySpark-native engine for numeric record streams, message tables and corpora."""
