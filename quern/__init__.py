"""A PySpark-native engine for retrieval-style analytics over text, vectors and small graphs."""
