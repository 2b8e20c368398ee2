"""A Spark-native engine for literature search and training-data preparation."""
