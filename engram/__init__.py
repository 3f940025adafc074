"""A Spark-native engine for storing, searching and associating short text records."""
