"""skerry: a PySpark-native engine for structured and semi-structured analytics."""
