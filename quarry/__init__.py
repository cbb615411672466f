"""A Spark-native engine for vector and text search over DataFrames."""
