"""Comparison, validation, sampling, schemas, partitions and table matching."""
