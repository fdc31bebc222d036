"""A Spark-native engine for industry intelligence and training data."""
