"""A PySpark-native analytics engine for citation catalogues and process events."""
