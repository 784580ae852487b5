"""A Spark-native engine for counted MinHash sketches of sequence data."""
