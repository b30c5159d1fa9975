"""A Spark-native analytics engine: a small SQL dialect and a matching DataFrame API over versioned tables."""
