"""corvane: a PySpark-native engine for code-intelligence analytics."""
