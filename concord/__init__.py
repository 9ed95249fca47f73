"""Spark-native reconciliation of two datasets."""
