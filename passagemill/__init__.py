"""A PySpark-native engine for retrieval experiments and training-data preparation."""
