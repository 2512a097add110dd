"""A PySpark-native SQL engine for hybrid search and analytics over tables with vector columns."""
