"""Scalar functions, aggregates, formats, type names and similarity."""
