"""Spark-native document analytics: every operator is a DataFrame or Column function."""
