"""A PySpark-native engine for analysing memories, vectors, logs and graphs."""
