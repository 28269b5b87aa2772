"""A Spark-native engine for causal structure in data whose distribution changes."""
