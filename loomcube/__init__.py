"""A Spark-native engine for category, document and entity analytics."""
