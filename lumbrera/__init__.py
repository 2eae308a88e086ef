"""lumbrera: a PySpark-native document-intelligence analytics engine."""
