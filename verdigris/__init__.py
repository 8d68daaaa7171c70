"""Spark-native engine for model-selection analytics: DataFrame and SQL plans, checked against SQL oracles."""
